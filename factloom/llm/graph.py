"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (columns a, b; any order, repeats allowed).

    Each round every node passes the smallest node that it knows to its larger
    neighbours, then every node ties its neighbours to the smallest of them, so
    that chains halve and a round's edges are no more than before.  All sums are
    minima, which combine before the shuffle, so a node with very many edges is
    no more work for one task.  Rounds are written tables; one is dropped once the
    next is stored.  Ends when a round changes nothing.
    """
    now = cut_lineage(_directed(edges))
    before = _digest(now)
    while True:
        low = _attach(now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a")), larger_only=True)
        after = cut_lineage(_attach(low.select(F.col("a").alias("node"), F.col("b").alias("other")), larger_only=False))
        found = _digest(after)
        if found == before:
            drop_table(after)
            break
        drop_table(now)
        now, before = after, found
    members = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().join(members.select("node"), "node", "left_anti")
    return members.union(roots.select("node", F.col("node").alias("component")))


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node ``a`` to the smaller ``b``."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _attach(known: DataFrame, larger_only: bool) -> DataFrame:
    """Tie the neighbours of each node (only those larger than it, or all) to the smallest of node and neighbours."""
    least = known.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    tied = known.join(least, "node")
    rows = tied.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")) if larger_only else tied.select(
        F.col("other").alias("a"), F.col("least").alias("b")
    ).union(least.select(F.col("node"), F.col("least")))
    return rows.where("a <> b").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
