"""Duplicate removal.

"Keep one row per key" is always an aggregation (``min_by``/``max_by`` over a
struct), never a window: partial aggregation leaves at most one row per key and
map task, so a key that holds a third of the table costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage


def _one_per_key(df: DataFrame, key: str, order: str, pick: Column, first: Column) -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy(key)
        .agg(pick.alias("_row"), first.alias("first_position"))
        .select("_row.*", "first_position")
    )


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key; ``first_position`` gives first-seen order."""
    row = F.struct(*df.columns)
    return _one_per_key(df, key, order, F.min_by(row, F.col(order)), F.min(order))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    row = F.struct(*df.columns)
    return _one_per_key(df, key, order, F.max_by(row, F.col(order)), F.min(order))


def prefer_success(df: DataFrame, key: str, order: str, success: str) -> DataFrame:
    """Latest success per key, else the latest row: a failure never replaces a
    success that came before it."""
    row = F.struct(*df.columns)
    rank = F.struct(F.coalesce(F.col(success), F.lit(False)), F.col(order))
    return _one_per_key(df, key, order, F.max_by(row, rank), F.min(order))


def content_key(body: Column) -> Column:
    return F.sha1(F.encode(body, "UTF-8"))


def prefix_key(body: Column, chars: int = 80) -> Column:
    """Key of chunks that open alike; the text itself is kept whole."""
    return T.compact(body, chars)


def evidence_key(source: Column, kind: Column, content: Column) -> Column:
    parts = [F.coalesce(source, F.lit("")), F.coalesce(kind, F.lit("")), T.compact(content, 240)]
    return F.concat_ws("\n", *[T.strip(F.lower(p)) for p in parts])


def first_by_any_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows a sequential scan keeps when a row is dropped as soon as one of its
    keys was already registered by a *kept* row.

    A row is certainly kept when it is the earliest undecided row of every one
    of its key groups, and certainly dropped when it shares a key with a kept
    row.  Deciding those two sets and repeating reaches exactly the sequential
    result; each round handles all rows at once, and only chains of rows that
    alternate between keys need a further round.  The earliest undecided row is
    always decided, so the rounds end.  A NULL key equals no other.  Rounds carry
    the order and the keys only.
    """
    undecided = df.select(order, *keys)
    kept: DataFrame | None = None
    while True:
        marked = undecided
        for i, key in enumerate(keys):
            firsts = undecided.groupBy(key).agg(F.min(order).alias(f"_first{i}"))
            marked = marked.join(firsts.filter(F.col(key).isNotNull()), key, "left")
        winner = reduce(lambda a, b: a & b, [F.col(k).isNull() | (F.col(f"_first{i}") == F.col(order)) for i, k in enumerate(keys)])
        marked = marked.select(order, *keys, winner.alias("_kept"))
        marked = cut_lineage(marked)
        new = marked.filter("_kept").select(order, *keys)
        kept = new if kept is None else kept.unionByName(new)
        undecided = marked.filter("not _kept").drop("_kept")
        for key in keys:
            undecided = undecided.join(new.select(key), key, "left_anti")
        undecided = cut_lineage(undecided)
        if undecided.isEmpty():
            return df.join(kept.select(order), order, "left_semi")
