"""N-gram Jaccard join: links between texts whose sets of word n-grams overlap by a share of their union.

1. Every text becomes the set of its distinct n-gram hashes (64 bits, lower-case
   A-Z).  Texts with equal sets are one *class* from here on.
2. Blocking without loss.  Sets of a band of sizes are dealt, element by element,
   into more parts than a linked pair of that band can have differing elements
   (and some to spare, for empty parts),
   so a linked pair has a part in common that is equal and not empty (a set with very
   many empty parts gives these as keys too).  The hash of each part's elements is a key.
   Mostly a linked pair must share several keys, and how many follows from the sizes and the parts that are
   full.  Pairs from blocks of up to ``MOST_PAIRED`` classes are counted and those that share too few are no
   candidates.  Larger blocks are not paired but tied together, and a class is left out of its
   largest blocks, as many as it can miss and still share a key with each set that may be linked to it.
   So a passage in many texts does not make one family of them.  Connected candidates form a family.
3. Prefix-tree join inside a family.  N-grams that occur in the same members
   count as one with a weight.  The sets, ordered by the family's
   frequency of their n-grams, are stored in a trie whose upper parts are shared.  The sets
   walk the trie together, each counting what matches and what is missed on either side,
   and a set leaves a subtree when the misses are more than any set of its sizes
   allows, or when all sets there are known to be connected with it already.
   So a family of thousands of copies is joined without forming its pairs.
4. A family with more than ``MOST_ELEMENTS`` elements in its sets is not put into one task: it is joined
   band by band (with the next smaller one), and where that is too much, key by key (once for all keys of the same
   classes), and keys with too many classes in pairs of chunks.
5. Links give components, by minima of edge tables.

Hash values stand for n-grams and classes: with 64 bits (classes: with their size) false equality is
negligible below some 10^9 classes.

Edge cases: null and empty texts, and texts without words, have an empty set, no links and are
their own component; a text of fewer words than an n-gram is one n-gram; repeated
rows are linked through their class; a row without a key is linked through an equal set only; ties go to
the smallest key; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table
from .graph import components
from .words import mix, shingles, text_slices, word_hashes

MOST_ELEMENTS = 2_000_000
CHUNK_CLASSES = 256
MOST_PAIRED = 16
TABLE_CELLS = 24_000_000


class Overlap:
    """Linked if ``100 * intersection >= percent * union``; all bounds in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def most_misses(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of ``a`` and ``b`` elements."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def bands(self, largest: int) -> np.ndarray:
        """First size of each band: a linked partner is in the same band or the next to it."""
        starts = [1]
        while starts[-1] <= largest:
            starts.append(100 * starts[-1] // self.percent + 1)
        return np.array(starts)

    def layout(self, low: int, top: int) -> tuple[int, int]:
        """(parts, spare) for sets of ``low`` to ``top`` elements, or (0, 0) if linked sets of these sizes are equal.

        Linked sets differ in at most ``misses`` parts, so that ``spare + 1`` parts or
        more are equal; ``spare`` is above the number of empty parts that a set of random hashes has, if that can be.
        """
        misses = self.most_misses(top, top)
        if misses == 0:
            return 0, 0
        spare = 1
        while spare < misses + 4:
            parts = misses + 1 + spare
            empty = parts * math.exp(-low / parts)
            if empty + 3 * math.sqrt(empty) < spare:
                break
            spare += 1
        return misses + 1 + spare, spare


def text_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    hashes, offsets = shingles(*word_hashes(texts), n)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def class_of(elements: np.ndarray) -> int:
    """Signed 64-bit name of a set: the same for equal sets."""
    total = mix(mix(elements).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(elements)))
    return int(total.view(np.int64)[0])


def _bands_of(size: int, rule: Overlap, bands: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(band, its largest size, parts, spare) of the two bands of a set, if linked sets there can differ."""
    own = int(np.searchsorted(bands, size, side="right")) - 1
    for band in (own, own + 1):
        top = int(bands[band + 1]) - 1
        parts, spare = rule.layout(int(bands[max(band - 1, 0)]), top)
        if parts:
            yield band, top, parts, spare


def _dealt(elements: np.ndarray, band: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Spread elements and the part of each."""
    spread = mix(elements + np.uint64(band * 2 + 1))
    return spread, ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def block_keys(elements: np.ndarray, rule: Overlap, bands: np.ndarray) -> np.ndarray:
    """Keys such that linked, different sets share one: 48 bits and below them one that tells a set's two bands apart."""
    out = []
    for band, _, parts, spare in _bands_of(len(elements), rule, bands):
        spread, part = _dealt(elements, band, parts)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, spread)
        full = np.bincount(part, minlength=parts) > 0
        keep = np.ones(parts, bool) if parts - np.count_nonzero(full) > spare else full
        where = np.flatnonzero(keep).astype(np.uint64)
        out.append(mix(sums[keep] + mix(where + np.uint64(band << 32))) >> np.uint64(16) << np.uint64(1) | np.uint64(band & 1))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def shared_keys(elements: np.ndarray, rule: Overlap, bands: np.ndarray) -> list[int]:
    """[needed, full] of the set's even band, then of its odd one.

    ``needed`` keys of the band at least are shared with any linked, different set of it.  With one of a certain
    size it is ``full``, its full parts, less ``most_misses`` of the two, for the larger ``full`` of both: parts
    that are empty in both are no keys.  A set that gives empty parts as keys promises one shared key.
    """
    size, out = len(elements), [1, 0, 1, 0]
    for band, top, parts, spare in _bands_of(size, rule, bands):
        full = np.count_nonzero(np.bincount(_dealt(elements, band, parts)[1], minlength=parts))
        if parts - full <= spare:
            misses = rule.most_misses(size, min(top, 100 * size // rule.percent))
            at = 2 * (band & 1)
            out[at : at + 2] = max(1, full - misses), full
    return out


# ---- the trie


class Node:
    __slots__ = ("grams", "weights", "children", "ends", "low", "high", "one")

    def __init__(self, grams, weights):
        self.grams, self.weights = grams, weights  # a path without branches
        self.children: dict[int, Node] = {}
        self.ends: list[int] = []  # sets that end here
        self.low, self.high = 1 << 60, 0  # sizes of the sets at and below
        self.one = -1  # a set at or below, if all there are known to be connected


def build(sets: list[list[int]], weights: list[int], sizes: list[int]) -> Node:
    """Trie of sets of gram numbers in ascending order; paths without branches are one node."""
    root = Node([], [])
    for number, grams in sorted(enumerate(sets), key=lambda x: x[1]):
        node, at, size = root, 0, sizes[number]
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == len(grams):
                node.ends.append(number)
                break
            child = node.children.get(grams[at])
            if child is None:
                child = Node(grams[at:], [weights[g] for g in grams[at:]])
                child.low = child.high = size
                child.ends.append(number)
                node.children[grams[at]] = child
                break
            shared, path = 0, child.grams
            while shared < len(path) and at + shared < len(grams) and path[shared] == grams[at + shared]:
                shared += 1
            if shared < len(path):
                upper = Node(path[:shared], child.weights[:shared])
                upper.low, upper.high = child.low, child.high
                child.grams, child.weights = path[shared:], child.weights[shared:]
                upper.children[child.grams[0]] = child
                node.children[grams[at]] = upper
                child = upper
            node, at = child, at + shared
    return root


class Family:
    """Sets of one family and what is known of their links."""

    def __init__(self, sets: list[np.ndarray], rule: Overlap):
        self.rule = rule
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.top = np.arange(len(sets))  # component of each set so far
        member = np.repeat(np.arange(len(sets)), self.sizes)
        grams, place = np.unique(np.concatenate(sets), return_inverse=True)
        # n-grams of the same members: equal sums of the members' marks
        marks = mix(np.arange(1, len(sets) + 1, dtype=np.uint64))
        sums = np.zeros(len(grams), np.uint64)
        np.add.at(sums, place, marks[member])
        seen = np.bincount(place, minlength=len(grams))
        alike, first, group = np.unique(sums, return_index=True, return_inverse=True)
        # frequent first, so that the trie's upper parts are shared
        order = np.lexsort((alike, -seen[first]))
        rank = np.empty(len(alike), np.int64)
        rank[order] = np.arange(len(alike))
        number = rank[group]
        self.weights = np.bincount(number, minlength=len(alike))
        # n-grams of one member come last; they match nothing, so tables leave them out
        self.shared = int(np.count_nonzero(seen[first] > 1))
        pairs = np.unique((member << 40) | number[place])
        own = np.searchsorted(pairs, np.arange(len(sets) + 1) << 40)
        self.sets = [(pairs[a:b] & ((1 << 40) - 1)).tolist() for a, b in zip(own[:-1], own[1:], strict=True)]

    def join(self, left: list[int] | None = None, right: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that connect all linked sets (of ``left`` with ``right``; otherwise of all with all)."""
        numbers = list(range(len(self.sets))) if right is None else right
        probes = numbers if left is None else left
        root = build([self.sets[i] for i in numbers], self.weights.tolist(), [int(self.sizes[i]) for i in numbers])
        todo = [root]
        while todo:
            node = todo.pop()
            node.ends = [numbers[e] for e in node.ends]
            todo += node.children.values()
        links: list[tuple[int, int]] = []
        batch = max(1, TABLE_CELLS // (self.shared + 1))
        for at in range(0, len(probes), batch):
            self._walk(np.array(probes[at : at + batch]), root, links)
        return links

    def _walk(self, probes: np.ndarray, root: Node, links: list[tuple[int, int]]) -> None:
        """Walk the trie with many sets at once, each carrying its matched weight; those that a bound rules out are dropped on the way."""
        shared = self.shared
        has = np.zeros((len(probes), shared + 1), bool)
        for row, i in enumerate(probes):
            own = self.sets[i]
            has[row, own[: bisect_left(own, shared)]] = True
        held = np.zeros((len(probes), shared + 1), np.int32)
        np.cumsum(has[:, :shared] * self.weights[:shared].astype(np.int32), axis=1, out=held[:, 1:])
        alone = self.sizes[probes] - held[:, shared]  # what no other set has is missed for certain
        size, percent = self.sizes[probes], self.rule.percent
        everyone = np.arange(len(probes))
        # (node, rows of probes, their matched weight, weight of the path above); None closes a node
        stack: list[tuple] = [(root, everyone, np.zeros(len(probes), np.int64), 0)]
        while stack:
            node, rows, common, above = stack.pop()
            if rows is None:
                self._settle(node)
                continue
            # linked sets differ in size by the share at most, and components that are known need no more links
            fits = (node.low * percent <= 100 * size[rows]) & (size[rows] * percent <= 100 * node.high)
            if node.one >= 0:
                fits &= self.top[probes[rows]] != self.top[node.one]
            if not fits.all():
                rows, common = rows[fits], common[fits]
            if len(rows) and node.grams:
                known = bisect_left(node.grams, shared)
                if known:
                    common = common + has[rows[:, None], np.array(node.grams[:known])[None]] @ np.array(node.weights[:known])
                above += sum(node.weights)
                missed = above + held[rows, min(node.grams[-1] + 1, shared)] + alone[rows] - 2 * common
                fits = missed <= (size[rows] + node.high) * (100 - percent) // (100 + percent)
                if not fits.all():
                    rows, common = rows[fits], common[fits]
            if not len(rows):
                continue
            for j in node.ends:
                linked = 100 * common >= percent * (size[rows] + self.sizes[j] - common)
                for i in probes[rows[linked]].tolist():
                    if self.top[i] != self.top[j]:
                        links.append((i, j))
                        self.top[self.top == self.top[i]] = self.top[j]
            stack.append((node, None, None, 0))
            for child in node.children.values():
                stack.append((child, rows, common, above))

    def _settle(self, node: Node) -> None:
        """Note that a subtree is all connected, once it is."""
        if node.one >= 0:
            return
        ones = list(node.ends)
        for child in node.children.values():
            if child.one < 0 and not child.children and len(child.ends) == 1:
                child.one = child.ends[0]
            if child.one < 0:
                return
            ones.append(child.one)
        if ones and (self.top[ones] == self.top[ones[0]]).all():
            node.one = ones[0]


# ---- Spark


_SIZED = "doc_id long, size long, class long, needed0 int, full0 int, needed1 int, full1 int"


def _sizes(n: int, rule: Overlap):
    """Per text the columns of ``_SIZED``: key, size, class and ``shared_keys``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = rule.bands(1 << 12)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                sets = text_sets(texts[a:b], n)
                bands = _reaching(bands, rule, sets)
                names = [class_of(s) if len(s) else None for s in sets]
                keys = np.array([shared_keys(s, rule, bands) if len(s) else [1, 0, 1, 0] for s in sets], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(map(len, sets), pa.int64()), pa.array(names, pa.int64()), *(pa.array(c) for c in keys.T)],
                    names=[c.split()[0] for c in _SIZED.split(", ")],
                )

    return work


def _reaching(bands: np.ndarray, rule: Overlap, sets: list[np.ndarray]) -> np.ndarray:
    """Bands that reach beyond the largest set."""
    top = max(map(len, sets))
    return rule.bands(8 * top) if bands[-2] <= top else bands


def _keys(n: int, rule: Overlap):
    """Per text with a key (node, keys); of equal sets in a batch only the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = rule.bands(1 << 12)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: set[int] = set()
            for a, b in text_slices(texts):
                sets = text_sets(texts[a:b], n)
                bands = _reaching(bands, rule, sets)
                nodes, keys = [], []
                for i, s in zip(ids[a:b], sets, strict=True):
                    if i is not None and len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        nodes.append(i)
                        keys.append(block_keys(s, rule, bands))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    return work


def join(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text",
         most_elements: int = MOST_ELEMENTS, chunk: int = CHUNK_CLASSES, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (smallest key reachable by links, itself included)."""
    rule = Overlap(percent)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sized = cut_lineage(rows.mapInArrow(_sizes(n, rule), _SIZED))
    # keys are many and are not stored; numbers of documents are shorter than names of classes
    keyed = rows.mapInArrow(_keys(n, rule), "node long, keys array<long>").select("node", F.explode("keys").alias("block")).repartition("block")
    block = Window.partitionBy("block")
    shared = keyed.withColumn("least", F.min("node").over(block)).withColumn("most", F.max("node").over(block)).where("most > least")
    shared = cut_lineage(shared.select("block", "node"))
    named = shared.join(sized.select(F.col("doc_id").alias("node"), "class").where("class IS NOT NULL"), "node").select("block", "class").distinct()
    # blocks of one class say nothing
    blocks = cut_lineage(named.withColumn("count", F.count("*").over(block)).where("count > 1"))
    drop_table(shared)
    families = cut_lineage(components(_candidates(sized, blocks, rule, most_paired)))
    found = _family_links(rows, sized, blocks, families, n, rule, most_elements, chunk)
    drop_table(blocks)
    drop_table(families)
    joined = components(found)
    # name components by the smallest key
    named = sized.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("top", F.coalesce("component", "class"))
    tops = named.where("class IS NOT NULL").groupBy("top").agg(F.min("doc_id").alias("smallest"))
    out = named.join(tops, "top", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def _candidates(sized: DataFrame, blocks: DataFrame, rule: Overlap, most_paired: int) -> DataFrame:
    """Edges (a, b) between classes that connect all linked ones."""
    # keys that only rows of one id share are not in blocks, so different texts of one id promise no more than a key
    ids = Window.partitionBy("doc_id")
    told = sized.where("class IS NOT NULL AND doc_id IS NOT NULL")
    told = told.withColumn("alone", F.min("class").over(ids) == F.max("class").over(ids))
    facts = ["size", "needed0", "full0", "needed1", "full1"]
    told = told.groupBy("class").agg(*[F.first(c).alias(c) for c in facts], F.min("alone").alias("alone"))
    band = F.col("block").bitwiseAND(F.lit(1))
    pick = lambda name, other: F.when(~F.col("alone"), other).when(band == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    own = blocks.join(told, "class").select(
        "block", "class", "count", "size", band.cast("int").alias("band"), pick("needed", 1).alias("needed"), pick("full", 0).alias("full")
    )
    # blocks are ranked alike for all classes: the more classes, the later
    mine = Window.partitionBy("class", "band")
    last = F.row_number().over(mine.orderBy(F.desc("count"), F.desc("block")))
    large = F.col("count") > most_paired
    own = cut_lineage(own.withColumn("last", last).withColumn("large", F.sum(large.cast("int")).over(mine)))
    kept = own.where(large & (F.col("last") >= F.col("needed")))
    ties = kept.select(F.col("class").alias("a"), F.min("class").over(Window.partitionBy("block")).alias("b"))
    small = own.where(~large)
    a = small.select("block", "band", F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("full").alias("full_a"), F.col("large").alias("large_a"))
    b = small.select("block", F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("full").alias("full_b"), F.col("large").alias("large_b"))
    pairs = a.join(b, "block").where("a < b").where(100 * F.least("size_a", "size_b") >= rule.percent * F.greatest("size_a", "size_b"))
    misses = F.floor((F.col("size_a") + F.col("size_b")) * (100 - rule.percent) / (100 + rule.percent))
    needed = F.greatest("full_a", "full_b") - misses - F.least("large_a", "large_b")
    pairs = pairs.select("a", "b", "band", needed.alias("needed")).groupBy("a", "b", "band").agg(F.count("*").alias("found"), F.min("needed").alias("needed"))
    edges = cut_lineage(ties.union(pairs.where("found >= needed").select("a", "b")).where("a <> b").distinct())
    drop_table(own)
    return edges


def _family_links(rows, sized, blocks, families, n, rule, most_elements, chunk) -> DataFrame:
    """Links (a, b) between classes."""
    one = sized.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"))
    members = families.select(F.col("node").alias("class"), F.col("component").alias("family")).join(one, "class")
    weights = members.groupBy("family").agg(F.sum("size").alias("elements"))
    members = cut_lineage(members.join(weights, "family"))
    small = members.where(F.col("elements") <= most_elements).select("doc_id", "class", F.col("family").alias("task"), F.lit(-1).alias("side"))
    large = members.where(F.col("elements") > most_elements).select("doc_id", "class", "size", "family")
    parts = [small]
    largest = large.agg(F.max("size")).first()[0]
    if largest:
        # linked sets are of one band of sizes or of two next to each other: each class goes to two groups
        starts = F.array(*[F.lit(int(b)) for b in rule.bands(largest)])
        band = F.size(F.filter(starts, lambda b: b <= F.col("size")))
        groups = large.withColumn("band", F.explode(F.array(band, band + 1)))
        weights = groups.groupBy("family", "band").agg(F.sum("size").alias("elements"))
        groups = groups.join(weights, ["family", "band"])
        parts.append(groups.where(F.col("elements") <= most_elements).select("doc_id", "class", F.xxhash64("family", "band").alias("task"), F.lit(-1).alias("side")))
        huge = groups.where(F.col("elements") > most_elements).select("doc_id", "class").distinct()
        # a block is joined in pairs of chunks: every chunk goes to the tasks of all pairs that it is in
        inside = blocks.select("block", "class").join(huge, "class")
        # blocks of the same classes are joined once
        counted = inside.groupBy("block").agg(F.count("*").alias("count"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("classes"))
        counted = counted.where("count > 1").groupBy("count", "classes").agg(F.min("block").alias("block")).drop("classes")
        inside = inside.join(counted, "block").withColumn("chunks", F.ceil(F.col("count") / chunk).cast("int"))
        inside = inside.withColumn("part", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        others = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        parts.append(others.select("doc_id", "class", F.xxhash64("block", low, high, F.lit(1)).alias("task"),
                                   F.when(low == high, -1).when(F.col("part") == low, 0).otherwise(1).alias("side")))
    tasks = functools.reduce(DataFrame.union, parts)
    wanted = tasks.select(F.col("doc_id").alias("wanted_id"), "class", "task", "side")
    # one row of the key is enough; equal keys with other texts are told apart by their class
    # what is wanted grows with the table: never broadcast, also where it is small by chance
    texts = rows.join(wanted.hint("merge"), rows.doc_id == F.col("wanted_id")).select("class", "text", "task", "side")

    def links(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("class", kind="stable")
        sets = []
        for a, b in text_slices(members["text"].tolist()):
            sets += text_sets(members["text"].tolist()[a:b], n)
        names = members["class"].to_numpy()
        right = np.array([len(s) > 0 and class_of(s) == c for s, c in zip(sets, names, strict=True)], bool)
        keep = right & ~pd.Series(names).where(pd.Series(right)).duplicated().to_numpy()
        sets, names, side = [s for s, k in zip(sets, keep, strict=True) if k], names[keep], members["side"].to_numpy()[keep]
        found: list[tuple[int, int]] = []
        if len(sets) > 1:
            family = Family(sets, rule)
            if (side >= 0).any():
                left, right_ = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
                found = family.join(left, right_) if left and right_ else []
            else:
                found = family.join()
        return pd.DataFrame({"a": [names[i] for i, _ in found], "b": [names[j] for _, j in found]}, dtype="int64")

    found = cut_lineage(texts.groupBy("task").applyInPandas(links, "a long, b long"))
    drop_table(members)
    return found


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, of the smallest key of each component.  Of rows equal in key and text one
    stays; rows without a key stay unless a row with a key is in their component."""
    kept = join(docs, key=key, text=text, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.coalesce("doc_id", F.lit(-1)).alias("kept_id"), F.col("doc_id").isNull().alias("kept_null")).distinct()
    names = docs.columns
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("kept_id"), F.col(key).isNull().alias("kept_null"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    )
    whole = rows.repartition("kept_id", "kept_null").join(kept, ["kept_id", "kept_null"], "left_semi")
    same = Window.partitionBy("kept_id", "kept_null").orderBy(F.xxhash64(f"row.{text}"))
    whole = whole.withColumn("before", F.lag(F.xxhash64(f"row.{text}")).over(same))
    whole = whole.where(F.col("before").isNull() | (F.col("before") != F.xxhash64(f"row.{text}")))
    return whole.select("row.*")
