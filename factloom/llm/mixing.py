"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents.  A document's virtual finish time
is the number of its source's words up to and with it, divided by the source's
target.  All queues are served at once, so at virtual time v a source has given
v times its target: the documents sorted by finish time are the mix.  At time 1
every source has given its target and the total is the budget, so each source is cut
at its own target and no running total over the sources is kept; a cut of the total would
differ only in the document that each source is serving then.  A source that must give more
than it has starts again (next pass) in another shuffled order.

Everything is DataFrame code.  The running sums inside a source are taken in
two steps (sums of hash buckets, then sums inside a bucket), so no task holds a
whole source, however large it is.

Edge cases: null and empty texts have size 0 and are never taken; a null source
is a source of its own and comes last; repeated rows count as often as they
occur; an empty table gives an empty mix; columns other than those named are
never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has source and source_size, one row per source.  Sources in code
    point order (null last) get the weights in turn and divide ``share`` times
    all words; no target exceeds ``most`` times its source, and what is over goes
    to the others by weight.  That water level is found in closed form: with the
    sources ordered by cap / weight, a source is capped exactly if the level that
    the sources before it leave is at least its own ratio.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after))
    # the level of the first source that is not capped holds for all after it
    first_open = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    return level.select(
        "source", "source_size",
        F.when(first_open.isNull() | (F.col("ratio") < first_open["ratio"]), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("weight") * first_open["level"], F.col("cap").cast("double"))).alias("target"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix in order: doc_id, source, size, source_size, target, pass, finish, words, copy, row_hash.

    One row per document and pass that the mix takes, sorted by virtual finish
    time.  ``words`` is the size of the document, less only for the document that
    a source is serving when the budget (the sum of the targets) is reached, at
    virtual time 1.  Reruns agree: the shuffle is a hash of row, pass and seed.
    Options as for ``schedule``.
    """
    order = ("finish", F.col("source").isNull(), "source", "pass", "slot", "doc_id", "row_hash", "copy")
    return schedule(docs, **options).where("words > 0").orderBy(*order).drop("slot")


def document_shares(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source, source_size, target, taken (words the mix takes, over all passes)."""
    return schedule(docs, **options).groupBy("doc_id", "row_hash", "copy").agg(
        F.first("size").alias("size"), F.first("source").alias("source"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("words").alias("taken"),
    ).drop("row_hash", "copy")


def row_hash(key: str, text: str, seed: int = 17) -> Column:
    """Hash that names a row in ``schedule``."""
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def schedule(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17,
             key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row in every pass with its virtual finish time and the words taken from it (0 or more)."""
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        row_hash(key, text, seed).alias("row_hash"),
    )
    same_row = Window.partitionBy("doc_id", "row_hash").orderBy("source")
    sized = cut_lineage(sized.withColumn("copy", F.row_number().over(same_row)))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    buckets = max(16, -(-sized.count() // BUCKET_ROWS))
    passes = sized.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(most)])))
    passes = passes.withColumn("slot", F.xxhash64("row_hash", "copy", "pass")).withColumn("bucket", F.pmod("slot", F.lit(buckets)))
    named = ("source", "pass", "bucket")
    sums = passes.groupBy(*named).agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    starts = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("of_source"), F.col("s.pass").alias("of_pass"), F.col("s.bucket").alias("of_bucket"),
        "before", "source_size", "target",
    )
    inside = Window.partitionBy(*named).orderBy("slot", "doc_id", "row_hash", "copy").rowsBetween(Window.unboundedPreceding, 0)
    run = passes.withColumn("inner_end", F.sum("size").over(inside)).join(
        starts,
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("pass") == F.col("of_pass")) & (F.col("bucket") == F.col("of_bucket")),
    )
    end = F.col("before") + F.col("inner_end")
    words = F.greatest(F.least(F.floor("target") - (end - F.col("size")), F.col("size")), F.lit(0))
    return run.select(
        "doc_id", "row_hash", "copy", "source", "size", "source_size", "target", "pass", "slot",
        F.when(F.col("target") > 0, end / F.col("target")).alias("finish"), words.alias("words"),
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17, **options) -> DataFrame:
    """The mix itself: the rows, with all their columns, in order of virtual finish time, once for each pass that takes them.

    Documents stay whole: the one that a source is serving at the end is taken if
    at least half of it is.  Texts are shuffled to their places in the schedule and then by the order.
    """
    names = docs.columns
    taken = schedule(docs, key=key, text=text, seed=seed, **options).where((F.col("words") > 0) & (2 * F.col("words") >= F.col("size")))
    taken = taken.select(F.coalesce("doc_id", F.lit(-1)).alias("k"), F.col("row_hash").alias("h"), "copy", "pass", "finish")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("k"), row_hash(key, text, seed).alias("h"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    one = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k", "h").orderBy(F.xxhash64("row")))).where("nth = 1")
    return one.join(taken, ["k", "h"]).orderBy("finish", "h", "k", "copy", "pass").select("row.*")
