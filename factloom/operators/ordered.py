"""Order-dependent logic over keys of any size.

A window over a whole key sorts that key in one task.  The helpers here cut a
key into buckets of its order (an hour of time, a block of positions), work
inside the buckets and then link the few bucket summaries, so no task ever sees
more than one bucket of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def _window(keys: list[str], order: list[str]) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def previous_value(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key."""
    staged = df.withColumn("_bucket", bucket)
    near = staged.withColumn(out, F.lag(value).over(_window([*keys, "_bucket"], order))).withColumn(
        "_head", F.row_number().over(_window([*keys, "_bucket"], order)) == 1
    )
    last = staged.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(_window(keys, ["_bucket"]))).drop("_last")
    return (
        near.join(carried, [*keys, "_bucket"], "left")
        .withColumn(out, F.when(F.col("_head"), F.col("_carry")).otherwise(F.col(out)))
        .drop("_bucket", "_head", "_carry")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Sum of ``value`` from the start of the key up to the row."""
    staged = df.withColumn("_bucket", bucket)
    inside = staged.withColumn(
        out, F.sum(value).over(_window([*keys, "_bucket"], order).rowsBetween(W.unboundedPreceding, 0))
    )
    totals = staged.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = totals.withColumn(
        "_before", F.sum("_sum").over(_window(keys, ["_bucket"]).rowsBetween(W.unboundedPreceding, -1))
    ).drop("_sum")
    return (
        inside.join(before, [*keys, "_bucket"], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_bucket", "_before")
    )


def longest_streak(df: DataFrame, keys: list[str], order: list[str], bucket: Column, failed: str) -> DataFrame:
    """Longest run of consecutive failures per key.

    Each bucket is reduced to (length, leading run, trailing run, longest run);
    neighbouring summaries are then joined over the buckets of the key.
    """
    staged = df.withColumn("_bucket", bucket)
    inside = _window([*keys, "_bucket"], order)
    islands = staged.withColumn("_ok", (~F.col(failed)).cast("long")).withColumn(
        "_island", F.sum("_ok").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    runs = islands.groupBy(*keys, "_bucket", "_island").agg(
        F.sum(F.col(failed).cast("long")).alias("_run"), F.count("*").alias("_rows")
    )
    summary = runs.groupBy(*keys, "_bucket").agg(
        F.sum("_rows").alias("_rows"),
        F.max("_run").alias("_longest"),
        F.max_by("_run", "_island").alias("_tail"),
        F.sum(F.when(F.col("_island") == 0, F.col("_run")).otherwise(0)).alias("_head"),
    )
    # buckets that failed throughout only extend the run they sit in
    across = _window(keys, ["_bucket"])
    linked = (
        summary.withColumn("_solid", F.col("_head") == F.col("_rows"))
        .withColumn("_chain", F.sum((~F.col("_solid")).cast("long")).over(across.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_joined", F.when(F.col("_solid"), F.col("_rows")).otherwise(F.col("_tail")))
        .withColumn(
            "_reach",
            F.sum("_joined").over(W.partitionBy(*keys, "_chain").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)),
        )
        .withColumn("_into", F.coalesce(F.lag("_reach").over(across), F.lit(0)) + F.col("_head"))
    )
    return linked.groupBy(*keys).agg(
        F.greatest(F.max("_longest"), F.max("_into"), F.max("_reach")).alias("longest_streak"),
        F.sum("_rows").alias("steps"),
    )


def ordered_text(df: DataFrame, keys: list[str], order: str, bucket: Column, value: str, separator: str, out: str) -> DataFrame:
    """Ordered concatenation per key, assembled bucket by bucket."""
    pieces = (
        df.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_part"))
        .withColumn("_part", F.array_join(F.transform("_part", lambda s: s["v"]), separator))
    )
    return pieces.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_part"))), lambda s: s["_part"]), separator
        ).alias(out)
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key.  The limit on the rank lets Spark cut every key
    to ``k`` rows in each map task, before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


# fixed value: lookups of a task of ttl_hits
_TASK_ROWS = 100_000


def ttl_hits(df: DataFrame, keys: list[str], order: list[str], bucket: Column, at: str, ttl: float) -> DataFrame:
    """Adds ``hit``: whether a cache that stores at a miss, for ``ttl`` seconds, answers the lookup.

    A hit does not renew what is stored, so a lookup's answer depends on all before
    it.  After a store, the next one is the first lookup ``ttl`` or more later.  Each
    key is cut into buckets of ``ttl`` width, which hold one store at most; every
    lookup gets a pointer to the store that would follow it, found in the bucket that its
    end falls into or at the head of the next one.  The stores are what the pointers reach from
    lookups that come ``ttl`` or more after their predecessor, and pointers double in
    each round, so a stretch of n buckets takes log2(n) rounds of written tables and no row holds a key.

    Joins and windows get a task for every ``_TASK_ROWS`` lookups: tasks get more with the log, not larger.

    ``order`` must not contradict ``at`` (in seconds); a lookup without a time is a miss that
    stores nothing.  ``bucket`` is not used: buckets follow from ``ttl``.
    """
    named = df.withColumn("_key", F.struct(*keys)).withColumn("_bucket", F.floor(F.col(at) / ttl))
    rows = cut_lineage(named.withColumn("_pos", F.row_number().over(_window(["_key", "_bucket"], [at, *order]))))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows.count() // _TASK_ROWS)
    dealt = lambda part, *by: part.repartition(tasks, *by)
    timed = rows.where(F.col("_bucket").isNotNull()).select("_key", F.struct("_bucket", "_pos").alias("_node"), "_bucket", F.col(at).cast("double").alias("_at"))
    across = _window(["_key"], ["_bucket"])
    spans = dealt(timed, "_key", "_bucket").groupBy("_key", "_bucket").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    spans = dealt(spans, "_key").withColumn("_before", F.lag("_last").over(across))
    starts = spans.where(F.col("_before").isNull() | (F.col("_first") - F.col("_before") >= ttl)).select("_key", F.struct("_bucket", F.lit(1).alias("_pos")).alias("_node"))
    # rows, and the ends of what each would store, in the buckets that they fall into
    ends = timed.withColumn("_at", F.col("_at") + ttl).withColumn("_bucket", F.floor(F.col("_at") / ttl))
    both = timed.withColumn("_is_row", F.lit(True)).union(ends.withColumn("_is_row", F.lit(False)))
    both = dealt(both.withColumn("_own", F.when(F.col("_is_row"), F.col("_node"))), "_key", "_bucket")
    back = W.partitionBy("_key", "_bucket").orderBy(F.desc("_at"), F.desc("_is_row"), F.desc("_node")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("_key").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    heads = dealt(both.groupBy("_key", "_bucket").agg(F.min("_own").alias("_head")), "_key")
    heads = dealt(heads.withColumn("_next", F.last("_head", True).over(later)).drop("_head"), "_key", "_bucket")
    near = both.withColumn("_to", F.last("_own", True).over(back)).where(~F.col("_is_row"))
    pointers = near.join(heads, ["_key", "_bucket"]).select("_key", "_node", F.coalesce("_to", "_next").alias("_to")).where(F.col("_to").isNotNull())
    stores = cut_lineage(starts)
    # the start of a stretch is known already: no pointer has to lead to it
    known = dealt(stores.withColumnRenamed("_node", "_to"), "_key", "_to")
    pointers = cut_lineage(dealt(pointers, "_key", "_to").join(known, ["_key", "_to"], "left_anti"))
    while not pointers.isEmpty():
        reached = dealt(stores, "_key", "_node").join(dealt(pointers, "_key", "_node"), ["_key", "_node"]).select("_key", F.col("_to").alias("_node"))
        stores = cut_lineage(stores.union(reached))
        further = dealt(pointers.select("_key", F.col("_node").alias("_to"), F.col("_to").alias("_end")), "_key", "_to")
        pointers = cut_lineage(dealt(pointers, "_key", "_to").join(further, ["_key", "_to"]).select("_key", "_node", F.col("_end").alias("_to")))
    rest = [c for c in df.columns if c not in (*keys, *order, at)]
    stored = dealt(stores.withColumn("_stored", F.lit(True)), "_key", "_node")
    found = dealt(rows.withColumn("_node", F.struct("_bucket", "_pos")), "_key", "_node").join(stored, ["_key", "_node"], "left")
    hit = F.col("_stored").isNull() & F.col("_bucket").isNotNull()
    return found.select(*keys, *order, at, *rest, hit.alias("hit"))
