"""Merging sparse and dense candidates, filters, quotas and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicons import DEFAULT, Lexicons
from . import cleaning as C
from . import lexical as L
from .dense import clamp01

# fixed values: weights and thresholds of the merged score
DENSE_WEIGHT, SPARSE_WEIGHT = 0.65, 0.35
DENSE_ONLY_MIN = 0.3
MIN_SPARSE, MIN_HYBRID = 5.0, 0.15
HIGH_HYBRID, HIGH_CROSS, HIGH_SPARSE_EXTRA = 0.4, 0.5, 2.0
PER_SOURCE = 2
REASONS = (
    "low_value_source", "noise", "low_value_project", "required_terms", "duplicate_source", "low_relevance", "over_limit",
)


def merge(sparse: DataFrame, dense: DataFrame, query_id: str, chunk_id: str = "chunk_id") -> DataFrame:
    """Full outer merge.  ``sparse`` has ``rerank_score``, ``dense`` has ``score``."""
    best = F.max("rerank_score").over(W.partitionBy(query_id))
    top = F.when(best <= 0, F.lit(MIN_SPARSE)).otherwise(best)
    left = sparse.select(
        query_id, chunk_id, "rerank_score", clamp01(F.col("rerank_score") / F.greatest(top, F.lit(1.0))).alias("sparse_norm")
    )
    right = dense.select(query_id, chunk_id, clamp01(F.col("score")).alias("dense_norm"))
    both = left.join(right, [query_id, chunk_id], "full_outer")
    dense_part = DENSE_WEIGHT * F.coalesce("dense_norm", F.lit(0.0))
    return both.filter(F.col("sparse_norm").isNotNull() | (F.col("dense_norm") >= DENSE_ONLY_MIN)).withColumn(
        "hybrid_score", dense_part + SPARSE_WEIGHT * F.coalesce("sparse_norm", F.lit(0.0))
    )


def per_source_rank(query_id: str, source: Column, order: list[Column]) -> Column:
    return F.row_number().over(W.partitionBy(query_id, source).orderBy(*order))


def search(
    candidates: DataFrame,
    query_id: str,
    score: str,
    limit: int = 4,
    hybrid: bool = True,
    cross: str | None = None,
    lex: Lexicons = DEFAULT,
) -> DataFrame:
    """Every candidate with ``discard_reason`` (NULL when it is returned).

    The order of the tests is part of the result: content filters, then the
    per-source quota, then relevance, then the limit.
    """
    source = F.coalesce(F.nullif("url", F.lit("")), F.col("chunk_id").cast("string"))
    low = F.lower(F.concat_ws(" ", "title", "url", "text"))
    flat = F.lower(T.squeeze(F.concat_ws("\n", "title", "url", "text")))
    trusted = F.coalesce(F.col("dense_norm"), F.lit(0.0)) >= DENSE_ONLY_MIN if hybrid else F.lit(False)
    content = (
        F.when(C.low_value_source(F.col("url"), lex), "low_value_source")
        .when(C.boilerplate_text(F.col("_flat"), lex), "noise")
        .when(L.low_value_project(F.col("_low"), lex), "low_value_project")
        .when(~trusted & ~L.required_terms_met(F.col("_low")), "required_terms")
    )
    ranking = [F.desc(cross)] if cross else []
    ranking += [F.desc(F.round(score, 9)), F.col("chunk_id")]
    staged = (
        candidates.withColumn("_low", low)
        .withColumn("_flat", flat)
        .withColumn("_content", content)
        .withColumn("_source", source)
        .withColumn("_open", F.col("_content").isNull())
    )
    floor = MIN_HYBRID if hybrid else MIN_SPARSE
    if cross:
        high = F.col(cross) >= HIGH_CROSS
    else:
        high = F.col(score) >= (HIGH_HYBRID if hybrid else MIN_SPARSE + HIGH_SPARSE_EXTRA)
    staged = staged.withColumn(
        "_nth", F.row_number().over(W.partitionBy(query_id, "_open", "_source").orderBy(*ranking))
    )
    passes = F.col("_open") & (F.col("_nth") <= PER_SOURCE) & (F.col(score) >= floor)
    staged = staged.withColumn("_passes", passes)
    staged = staged.withColumn(
        "_place", F.row_number().over(W.partitionBy(query_id, "_passes").orderBy(*ranking))
    )
    reason = (
        F.when(~F.col("_open"), F.col("_content"))
        .when(F.col("_nth") > PER_SOURCE, "duplicate_source")
        .when(F.col(score) < floor, "low_relevance")
        .when(F.col("_place") > limit, "over_limit")
    )
    return (
        staged.withColumn("discard_reason", reason)
        .withColumn("high_relevance", high & F.col("discard_reason").isNull())
        .drop("_low", "_flat", "_content", "_source", "_open", "_nth", "_passes", "_place")
    )


def diagnostics(searched: DataFrame, query_id: str) -> DataFrame:
    """Counters per query."""
    counts = [F.count_if(F.col("discard_reason") == r).alias(f"discarded_{r}") for r in REASONS if r != "over_limit"]
    kept = F.count_if(F.col("discard_reason").isNull())
    high = F.count_if("high_relevance")
    return searched.groupBy(query_id).agg(
        F.count("*").alias("candidate_count"),
        kept.alias("kept_count"),
        *counts,
        high.alias("high_relevance_count"),
        F.when(kept > 0, F.round(high / kept, 4)).otherwise(F.lit(0.0)).alias("high_relevance_rate"),
    )
