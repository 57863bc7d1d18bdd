"""Search plans: sparse, dense and merged, with diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicons
from ..operators import hybrid, stored_index
from ..operators import lexical as L
from ..session import cut_lineage, spread


def sparse(
    queries: DataFrame, chunks: DataFrame, query_id: str, query: str, lex: Lexicons = DEFAULT, posts: DataFrame | None = None,
    lens: DataFrame | None = None, limit: int = L.CANDIDATES, index: stored_index.Index | None = None,
) -> DataFrame:
    """Ranked candidates of every query with their chunk and profile columns.

    With ``index`` they come from the stored index, with ``posts`` from those postings; otherwise ``chunks`` are scanned once
    for the terms of all queries.  Queries whose terms match nothing fall back to the first
    specific terms with a constant score.
    """
    profiled = L.query_profile(queries, query, lex)
    if index is not None:
        found = stored_index.search(profiled, index, query_id, limit)
    elif posts is not None:
        found = L.bm25(profiled, posts, L.lengths(chunks) if lens is None else lens, query_id, limit)
    else:
        found = L.bm25_scan(profiled, chunks, query_id, limit)
    found = cut_lineage(found)
    unmatched = profiled.join(found.select(query_id).distinct(), query_id, "left_anti")
    loose = stored_index.contains_search(unmatched, chunks, query_id, limit)
    if loose is None:
        loose = L.like_search(unmatched, chunks, query_id, limit)
    # written: the planner then sees how few they are, and does not shuffle the texts to meet them
    return with_context(cut_lineage(found.unionByName(loose)), profiled, chunks, query_id)


def with_context(hits: DataFrame, profiled: DataFrame, chunks: DataFrame, query_id: str) -> DataFrame:
    """Chunk columns by the few ids that were hit, then the query's profile."""
    found = hits.join(chunks.select("chunk_id", "title", "url", "text"), "chunk_id").join(profiled, query_id)
    return spread(found, query_id, "chunk_id", scan=False)


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, dense_hits: DataFrame, query_id: str, query: str, lex: Lexicons = DEFAULT,
    limit: int = 4, posts: DataFrame | None = None, lens: DataFrame | None = None, index: stored_index.Index | None = None,
) -> DataFrame:
    """All candidates with scores and ``discard_reason``.

    ``dense_hits`` has ``query_id, chunk_id, score``.
    """
    profiled = L.query_profile(queries, query, lex)
    ranked = L.rerank(sparse(queries, chunks, query_id, query, lex, posts, lens, index=index), query, lex)
    merged = cut_lineage(hybrid.merge(ranked, dense_hits, query_id))
    full = with_context(merged, profiled, chunks, query_id)
    return hybrid.search(full, query_id, "hybrid_score", limit, hybrid=True, lex=lex)


def sparse_search(ranked: DataFrame, query_id: str, lex: Lexicons = DEFAULT, limit: int = 4) -> DataFrame:
    """Same filters and quota on reranked sparse candidates alone."""
    return hybrid.search(
        ranked.withColumn("dense_norm", F.lit(None).cast("double")), query_id, "rerank_score", limit, hybrid=False, lex=lex
    )


def best_per_source(hits: DataFrame, query_ids: list[str], source: str, score: str, order: str, limit: int) -> DataFrame:
    """Results of several queries of one sample merged: the first hit of each
    source in query order stays, then the best by score."""
    from ..operators.ordered import top_k

    keep = [c for c in hits.columns if c not in (*query_ids, source)]
    first = (
        hits.groupBy(*query_ids, source)
        .agg(F.min_by(F.struct(*keep), F.struct(order, F.negative(score))).alias("_h"))
        .select(*query_ids, source, "_h.*")
    )
    return top_k(first, query_ids, [F.desc(score), F.col(source)], limit)
