"""Filter interaction audit: what each filter removes, in every order of the filters, by sorted posting lists.

1. Every row gets the set of filters that it fails.  ``failures`` does so for the five text
   filters of the query; any table with a bit mask of failures does.
2. Rows are range-partitioned by (part, id) and cut into id ranges.  For each range the
   posting list of a filter holds the places of its failing ids in ascending order, and so
   do the lists of good and of toxic documents.
3. For every set of earlier filters its union is formed by a k-way merge that gallops: the
   list with the smallest head is copied up to the next list's head.  What a filter removes
   after them is the difference of its list and that union, again by galloping.
4. Sizes of ranges are summed for each part, and the steps of all orders are read off the sums: an
   order's step depends only on its filter and on the set of filters before it.

No part is gathered anywhere: a part with a third of all rows has more ranges.  Identical
texts are found by their SHA-256, with the smallest id of each as an aggregate, and rows are
told to be first by (id, text), so that a text with very many copies is no hot key.

Edge cases: a null text is empty, and all empty texts are identical; a null part is the empty string; a row
without an id has no labels and is never a later copy (nor does it make others so); repeated rows
count once each and are no copies of each other, as neither id is smaller; of repeated labels a 1 counts;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FILTERS = "ABCDE"
SPACE = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS = 200


# ---- sorted lists


def gallop(items: list[int], target: int, start: int) -> int:
    """First place from ``start`` on whose item is not below ``target``: steps that double, then halving."""
    step, low, n = 1, start, len(items)
    while low + step < n and items[low + step] < target:
        low += step
        step *= 2
    return bisect_left(items, target, low, min(low + step + 1, n))


def union(lists: list[list[int]]) -> list[int]:
    """Distinct items of sorted lists, by a k-way merge of galloping runs."""
    heads = [[items[0], number, 0] for number, items in enumerate(lists) if items]
    out: list[int] = []
    while len(heads) > 1:
        heads.sort()
        (head, number, at), limit = heads[0], heads[1][0]
        items = lists[number]
        if head == limit:
            at += 1  # the other list has it as well
        else:
            end = gallop(items, limit, at)
            out += items[at:end]
            at = end
        if at < len(items):
            heads[0] = [items[at], number, at]
        else:
            heads.pop(0)
    if heads:
        out += lists[heads[0][1]][heads[0][2] :]
    return out


def difference(items: list[int], gone: list[int]) -> list[int]:
    """Items of a sorted list that are not in the other."""
    out: list[int] = []
    at = place = 0
    while at < len(items):
        place = gallop(gone, items[at], place)
        if place == len(gone):
            out += items[at:]
            break
        if gone[place] == items[at]:
            at += 1
        else:
            end = gallop(items, gone[place], at)
            out += items[at:end]
            at = end
    return out


def common(a: list[int], b: list[int]) -> int:
    """Number of items in both sorted lists."""
    return len(a) - len(difference(a, b)) if len(a) <= len(b) else len(b) - len(difference(b, a))


# ---- rows


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", least_words: int = LEAST_WORDS) -> DataFrame:
    """part, doc_id and ``fails`` (bit i: filter i of ABCDE) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).cast("long").alias("doc_id"), body.alias("body"))
    words = F.array_remove(F.split("body", SPACE), "")
    upper = F.length("body") - F.length(F.regexp_replace("body", "[A-Z]", ""))
    failing = [
        F.size(words) < least_words,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * upper > 2 * F.length("body"),
        F.col("body").rlike("[#$%&*|]"),
    ]
    mask = functools.reduce(Column.__add__, [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(failing)])
    # one pass over the texts; from here on they are their digests
    seen = cut_lineage(rows.select("part", "doc_id", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest")))
    first = seen.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = seen.join(first, ["doc_id", "digest"], "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << len(failing)).otherwise(0)
    return marked.select("part", "doc_id", (F.col("mask") + copy).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with good and toxic from ``labels``."""
    is_one = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id"))
    known = known.agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    out = rows.join(known, "doc_id", "left")
    return out.select("part", "doc_id", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


LISTS = "part string, ids array<long>, failing array<array<int>>, good array<int>, toxic array<int>"


def posting_lists(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """One row per part and id range: its ids in order, and the places in them of the ids that fail each filter, and of good and toxic ones."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_pylist()
            fails, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            edges = [0, *[i for i in range(1, len(part)) if part[i] != part[i - 1]], len(part)]
            out = []
            for a, b in itertools.pairwise(edges):
                if a < b:
                    places = [np.flatnonzero(fails[a:b] >> f & 1).tolist() for f in range(filters)]
                    out.append((part[a], batch.column(1).slice(a, b - a).to_pylist(), places, np.flatnonzero(good[a:b]).tolist(), np.flatnonzero(toxic[a:b]).tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "ids", "failing", "good", "toxic"])

    # a batch is a range: ids in order, bounded by the session's Arrow batch size
    rows = cut_lineage(rows.select("part", "doc_id", "fails", "good", "toxic"))
    ordered = rows.repartitionByRange("part", "doc_id", "fails").sortWithinPartitions("part", "doc_id", "fails")
    return ordered.mapInArrow(lists, LISTS)


def removals(lists: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, step, before, n, good, toxic: the sizes, summed over ranges, of what filter ``step`` removes after the set ``before`` (a bit
    mask); for ``step`` = -1 those of the union of ``before``, and of the part itself where that is 0."""
    sets = range(1 << filters)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                failing, good, toxic = row["failing"], row["good"], row["toxic"]
                unions = [union([failing[f] for f in range(filters) if s >> f & 1]) for s in sets]
                out = [(-1, 0, len(row["ids"]), len(good), len(toxic))]
                out += [(-1, s, len(unions[s]), 0, 0) for s in sets if s]
                for f in range(filters):
                    for s in sets:
                        if not s >> f & 1:
                            gone = difference(failing[f], unions[s])
                            out.append((f, s, len(gone), common(gone, good), common(gone, toxic)))
                numbers = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(out)), *[pa.array(numbers[:, i]) for i in range(5)]], names=["part", "step", "before", "n", "good", "toxic"])

    sizes = lists.mapInArrow(merge, "part string, step long, before long, n long, good long, toxic long")
    return sizes.groupBy("part", "step", "before").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(lists: DataFrame, names: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k = len(names)
    everything = (1 << k) - 1
    codes = [(-1, s) for s in range(1 << k)] + [(f, s) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    at = {code: i for i, code in enumerate(codes)}
    # every part has all of ``codes``, a fixed number, so that their place in the sorted array is known
    found = removals(lists, k).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("step", "before", "n", "good", "toxic"))).alias("sums"))
    of = lambda f, s: F.col("sums")[at[f, s]]["n"]
    weight = lambda s: math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())
    shapley = F.array(*[sum((of(f, s) * weight(s) for s in range(1 << k) if not s >> f & 1), F.lit(0)) for f in range(k)])
    found = found.withColumn("shapley", shapley)
    orders = ["".join(p) for p in itertools.permutations(names)]
    rows = []  # of each step: filter, place of its removal, of its whole list, of the union after it, of what only it finds
    for order in orders:
        before = 0
        for letter in order:
            f = names.index(letter)
            after = before | 1 << f
            rows.append((f, at[f, before], at[f, 0], at[-1, after], at[f, everything & ~(1 << f)]))
            before = after
    table = [F.array(*[F.lit(row[i]) for row in rows])[F.col("i")] for i in range(5)]
    out = found.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))))
    n = lambda place: F.col("sums")[place]["n"]
    removed = F.col("sums")[table[1]]
    return out.select(
        "part",
        F.array(*[F.lit(o) for o in orders])[F.floor(F.col("i") / k).cast("int")].alias("filter_order"),
        (F.col("i") % k + 1).cast("int").alias("step"),
        (n(F.lit(at[-1, 0])) - n(table[3])).alias("kept"),
        removed["n"].alias("removed"),
        (n(table[2]) - removed["n"]).alias("redundant"),
        n(table[4]).alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        F.col("shapley")[table[0]].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters over all rows of ``docs``."""
    return audit(posting_lists(labelled(failures(docs), labels)))
