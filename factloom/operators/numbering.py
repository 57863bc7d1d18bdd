"""Dense numbers over a total order of a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], out: str, first: int = 0) -> DataFrame:
    """``df`` with ``out``: first, first + 1, ... in ascending ``order`` (nulls first), without gaps.

    Rows are range-partitioned and sorted; each range counts its own rows, and a row's number is its place in the range plus
    the rows of the ranges before.  Only one count a range is gathered.  Rows that tie in ``order`` are numbered in some order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    # written once: the places must be those that were counted
    ranged = cut_lineage(ranged)
    piece = F.shiftright("_place", 33)
    counts = ranged.groupBy(piece.alias("piece")).agg(F.count("*").alias("n")).orderBy("piece").collect()
    before, starts = first, []
    for row in counts:
        starts.append((row["piece"], before))
        before += row["n"]
    table = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.create_map(F.lit(0).cast("long"), F.lit(first).cast("long"))
    start = F.element_at(table, piece).cast("long")
    return ranged.withColumn(out, start + F.col("_place").bitwiseAND(F.lit(_LOCAL))).drop("_place")
