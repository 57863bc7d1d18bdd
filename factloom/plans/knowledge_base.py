"""Knowledge base builders.

A builder is one lazy frame per stage.  Rejected pages stay in the frame with
``reject_reason`` set, so counters are a group-by and nothing is lost silently;
``write`` stores pages, chunks and the term index as Parquet.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..lexicons import DEFAULT, Lexicons
from ..operators import chunking, cleaning, dedup, numbering, stored_index
from ..session import cut_lineage
from ..sources import headers
from ..sources import pages as pages_source


@dataclass(frozen=True)
class KnowledgeBase:
    funnel: DataFrame  # every page with reject_reason (NULL when kept)
    pages: DataFrame
    unnumbered: DataFrame  # chunks without ids
    order: str  # column that orders the pages

    @functools.cached_property
    def chunks(self) -> DataFrame:
        """Chunks with ``chunk_id``; numbered when first asked for, as that writes a table."""
        return with_ids(self.unnumbered, self.order)


def counters(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("pages"))


def _finish(staged: DataFrame, order: str, sections: bool, lex: Lexicons, exact: bool) -> KnowledgeBase:
    """Deduplicate accepted pages by address and by text, chunk, report.

    The judged pages are written once: the funnel, the deduplication and the
    chunker all read them, and the cleaning rules run a single time.
    """
    staged = cut_lineage(staged)
    key = F.coalesce(T.blank_to_null(F.col("url")), F.col("text_hash"))
    accepted = staged.filter(F.col("reject_reason").isNull()).withColumn("_key", key)
    chunker = chunking.section_chunks if sections else chunking.overlap_chunks
    if exact:
        unique = dedup.first_by_any_key(accepted, ["_key", "text_hash"], order)
    else:
        # two passes: by address, then by text among the survivors
        by_url = dedup.keep_first(accepted, "_key", order).drop("first_position")
        unique = dedup.keep_first(by_url, "text_hash", order).drop("first_position")
    chunks = chunker(unique.drop("_key", "reject_reason"), "text")
    if sections:
        chunks = chunks.filter(cleaning.chunk_is_useful(F.col("chunk_text"), lex))
    with_chunks = chunks.select(order).distinct().withColumn("_chunked", F.lit(True))
    state = unique.select(order).withColumn("_unique", F.lit(True)).join(with_chunks, order, "left")
    reason = F.coalesce(
        F.col("reject_reason"),
        F.when(F.col("_unique").isNull(), "duplicate").when(F.col("_chunked").isNull(), "no_chunks"),
    )
    funnel = staged.join(state, order, "left").withColumn("reject_reason", reason).drop("_unique", "_chunked")
    pages = unique.drop("_key", "reject_reason").join(with_chunks.drop("_chunked"), order, "left_semi")
    return KnowledgeBase(funnel, pages, chunks, order)


def with_ids(chunks: DataFrame, order: str) -> DataFrame:
    """``chunk_id``: dense numbers from 0 by page and place in the page, however many pages and chunks there are."""
    return numbering.numbered(chunks, [order, "chunk_index"], "chunk_id")


def basic(pages: DataFrame, order: str, lex: Lexicons = DEFAULT, exact: bool = True) -> KnowledgeBase:
    """``pages`` has a total order column, ``title, url, text, text_hash``."""
    flat = pages.withColumn("_flat", T.squeeze(F.col("text")))
    reason = cleaning.useful_reason(F.col("title"), F.col("url"), F.col("_flat"), lex)
    return _finish(flat.withColumn("reject_reason", reason).drop("_flat"), order, False, lex, exact)


def filtered_public(pages: DataFrame, order: str, lex: Lexicons = DEFAULT, exact: bool = True) -> KnowledgeBase:
    """Source rule, page rule, cleaning, then the basic rules on the clean text."""
    allowed = cleaning.source_allowed(F.col("title"), F.col("url"), lex)
    raw = pages.withColumn("_flat", T.squeeze(F.col("text")))
    first = F.when(~allowed, "source").otherwise(
        cleaning.useful_reason(F.col("title"), F.col("url"), F.col("_flat"), lex)
    )
    staged = raw.withColumn("_first", first)
    staged = cleaning.clean_public_text(staged, "text", "_clean", lex).withColumn("_cflat", T.squeeze(F.col("_clean")))
    body, title = F.col("_clean"), F.col("title")
    second = (
        F.when(~cleaning.cleaned_is_valid(body, title, lex), "invalid_after_clean")
        .when(~cleaning.technical_enough(body, title, lex), "not_technical")
        .otherwise(cleaning.useful_reason(title, F.col("url"), F.col("_cflat"), lex))
    )
    staged = (
        staged.withColumn("reject_reason", F.coalesce("_first", second))
        .withColumn("text", body)
        .withColumn("text_hash", F.sha1(F.encode("text", "UTF-8")))
        .drop("_flat", "_first", "_clean", "_cflat")
    )
    return _finish(staged, order, False, lex, exact)


def diagnosis(pages: DataFrame, order: str, max_docs: int | None = None, lex: Lexicons = DEFAULT, exact: bool = True) -> KnowledgeBase:
    """The filtered rules in two phases: headers first, then bodies.

    ``max_docs`` keeps the first documents in scan order, after all filters.
    """
    allowed = pages.filter(cleaning.source_allowed(F.col("title"), F.col("url"), lex))
    kb = filtered_public(allowed, order, lex, exact)
    if max_docs is None:
        return kb
    first = kb.pages.select(order).orderBy(order).limit(max_docs)
    return KnowledgeBase(
        kb.funnel, kb.pages.join(first, order, "left_semi"), kb.unnumbered.join(first, order, "left_semi"), order
    )


def diagnosis_from_files(
    spark: SparkSession, roots: list[str], forbidden: tuple[str, ...] = (), max_docs: int | None = None, lex: Lexicons = DEFAULT, **scan
) -> tuple[KnowledgeBase, DataFrame]:
    """The two phases over page files: heads first, then the bodies of the files whose source is allowed.  Returns the knowledge base and the
    files that it never opened, with ``reject_reason`` (``oversized``, ``read_error``, ``source``).  Pages are numbered by (root, page number, path)."""
    heads = headers.scan_heads(spark, roots, forbidden, **scan)
    known = pages_source.headers(heads)
    allowed = cleaning.source_allowed(F.col("title"), F.col("url"), lex)
    known = cut_lineage(known.withColumn("reject_reason", F.coalesce("reject_reason", F.when(~allowed, "source"))))
    wanted = numbering.numbered(known.where("reject_reason IS NULL").select("path", "source_no", "page_no"), ["source_no", "page_no", "path"], "page_order")
    whole = headers.with_bodies(wanted).withColumn("raw", pages_source.decode(F.col("content"))).drop("content")
    parsed = pages_source.parse(whole, "raw", "path")
    return diagnosis(parsed, "page_order", max_docs, lex), known.where("reject_reason IS NOT NULL")


MIN_ARTICLE = 200


def quality_headers(pages: DataFrame, order: str, lex: Lexicons = DEFAULT, rules: DataFrame | None = None) -> DataFrame:
    """The first phase: order, title, url, host, ``quick`` (checked terms in title and address) and ``reject_reason``
    (host_rules, low_value_source, no_terms), from the columns of a header alone."""
    staged = pages.select(order, "title", "url", U.host(F.col("url")).alias("host"))
    staged = staged.withColumn("_path", F.lower(U.path(F.col("url")))).withColumn("_title", F.lower(F.coalesce(T.strip(F.col("title")), F.lit(""))))
    rules = pages_source.host_rules(pages.sparkSession) if rules is None else rules
    staged = pages_source.apply_host_rules(staged, rules, "host", "_path", "_title").drop("_path", "_title")
    low = F.lower(F.concat_ws("\n", "title", "url"))
    staged = staged.withColumn("quick", T.hits(low, [m.lower() for m in lex.quick_check]))
    reason = (
        F.when(~F.col("allowed"), "host_rules").when(cleaning.low_value_source(F.col("url"), lex), "low_value_source").when(F.col("quick") == 0, "no_terms")
    )
    return staged.withColumn("reject_reason", reason).drop("allowed")


def first_kept(pages: DataFrame, order: list[str], most: int | None, out: str = "place") -> DataFrame:
    """``pages`` numbered from 0 in ``order``; with ``most`` only the first so many.  A prefix count over ranges: nothing is sorted in one place, and
    what comes after the cut is not looked at again."""
    placed = numbering.numbered(pages, order, out)
    return placed if most is None else placed.where(F.col(out) < most)


def high_quality(
    pages: DataFrame, order: str, max_docs: int | None = None, floor: int = 3, lex: Lexicons = DEFAULT, by_prefix: bool = False, rules: DataFrame | None = None
) -> KnowledgeBase:
    """Header phase; clean, split into articles, best article by page quality, section chunks with a context prefix; then
    the first page of each address in order of the header score, and of these the first ``max_docs`` (default: all), then chunk dedup.

    The stop counts pages that passed every filter, so the pages it keeps do not depend on how many were looked at.  Chunks are duplicates when
    their bodies are equal; ``by_prefix`` uses the first 80 characters of the prefixed chunk instead.  Tables are written behind the headers, behind the
    cleaning and behind the chunks, so that no rule runs twice.
    """
    heads = cut_lineage(quality_headers(pages, order, lex, rules))
    open_ = heads.where("reject_reason IS NULL").select(order, "host", F.negative("quick").alias("_rank"))
    deep = pages.drop("text_hash", "host").join(open_, order)
    cleaned = cleaning.clean_public_text(deep, "text", "_clean", lex).drop("text")
    cleaned = cut_lineage(cleaning.strip_host_lines(cleaned, "_clean", "host", "text").drop("_clean"))
    whole = cleaned.where(F.length("text") >= MIN_ARTICLE)
    articles = chunking.split_articles(whole, "text", "title").where(F.length("article") >= MIN_ARTICLE)
    scored = cut_lineage(cleaning.page_quality(articles.drop("text"), "title", "url", "article", lex, host="host"))
    # the best article by its key alone, then its text
    best = scored.groupBy(order).agg(F.max(F.struct("quality", F.negative("article_rank").alias("back"))).alias("_b"))
    best = best.select(F.col(order).alias("_o"), F.col("_b.quality").alias("_q"), F.negative("_b.back").alias("_a"))
    best = best.where(F.col("_q") >= floor)
    chosen = scored.join(best, (F.col(order) == F.col("_o")) & (F.col("article_rank") == F.col("_a"))).drop("_o", "_q", "_a", "article_rank")
    chosen = chosen.drop(*[c for c in chosen.columns if c.startswith("q_")]).withColumnRenamed("article", "text")
    chunks = chunking.section_chunks(chosen, "text")
    chunks = cut_lineage(chunks.where(cleaning.chunk_is_useful(F.col("chunk_text"), lex)))
    chunked = chunks.select(order, "_rank", "url").dropDuplicates([order])
    key = F.coalesce(T.blank_to_null(F.col("url")), F.concat(F.lit("#"), F.col(order).cast("string")))
    firsts = chunked.groupBy(key.alias("_key")).agg(F.min(F.struct("_rank", order)).alias("_f")).select("_f.*")
    kept = cut_lineage(first_kept(firsts, ["_rank", order], max_docs).drop("_rank"))

    known = [
        (cleaned.where(F.length("text") >= MIN_ARTICLE), "_whole"), (best.select(F.col("_o").alias(order)), "_good"), (chunked, "_chunked"), (firsts, "_first"), (kept, "_kept"),
    ]
    funnel = heads
    for table, flag in known:
        funnel = funnel.join(table.select(order).withColumn(flag, F.lit(True)), order, "left")
    reason = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col("_whole").isNull(), "empty_after_clean")
        .when(F.col("_good").isNull(), "low_quality")
        .when(F.col("_chunked").isNull(), "no_chunks")
        .when(F.col("_first").isNull(), "duplicate")
        .when(F.col("_kept").isNull(), "over_limit")
    )
    funnel = funnel.withColumn("reject_reason", reason).drop(*[flag for _, flag in known])
    prefixed = F.concat(F.lit("[文档: "), F.substring("title", 1, 100), F.lit("] [来源: "), "host", F.lit("] "), "chunk_text")
    chunks = chunks.drop("_rank").join(kept, order).withColumn("text", prefixed)
    same = dedup.prefix_key(F.col("text")) if by_prefix else dedup.content_key(F.col("chunk_text"))
    # the first chunk of each content by its key alone: no text is held in an aggregate
    keyed = chunks.withColumn("_k", same)
    first = keyed.groupBy("_k").agg(F.min(F.struct("place", "chunk_index")).alias("_f")).select("_f.*")
    unique = keyed.drop("_k").join(first, ["place", "chunk_index"], "left_semi")
    return KnowledgeBase(funnel, chosen.drop("_rank").join(kept, order), unique, "place")


def write(kb: KnowledgeBase, folder: str) -> stored_index.Index:
    """Parquet tables ``pages`` and ``chunks``, ``build_counts``, and the term index of the chunks (``postings``, ``bounds``,
    ``vocabulary``, ``summary``), which ``stored_index.open_index`` opens from the same folder.  The folder must be new; the index is complete last."""
    kb.pages.write.parquet(f"{folder}/pages")
    kb.chunks.write.parquet(f"{folder}/chunks")
    counters(kb.funnel).write.json(f"{folder}/build_counts")
    stored = kb.chunks.sparkSession.read.parquet(f"{folder}/chunks")
    return stored_index.build(stored, folder, body="chunk_text")


