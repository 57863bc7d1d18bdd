"""MinHash near-duplicates with b-bit signatures: candidates by bands, estimates by bit counts, links by full sets.

1. Every text becomes the set of its distinct n-gram hashes (64 bits, lower-case A-Z). Texts with
   equal sets are one *class*.  A class has ``BANDS * ROWS`` minima, each under its own random
   linear map.  The minima of a band give one key, so classes of similarity t miss each other
   in all bands with probability (1 - t**ROWS)**BANDS (7e-11 at 0.85).  Of each minimum only the low
   ``BITS`` bits are kept, packed into bit planes.
2. Two signatures agree in a share m of places, of which 2**-BITS by chance: (m - 2**-BITS) / (1 - 2**-BITS)
   estimates the similarity, by XOR and bit counts on whole words.  Only pairs whose estimate is more than ``SIGMAS`` standard deviations
   below the threshold are dismissed (one linked pair in 10^9).
3. Links, confirmed on full sets.  First each class is compared with the smallest class of its bands that its
   signature is nearest to, one comparison a class; that joins most copies.  Then only bands that hold more than one
   component are left.  Their signatures are compared in pairs of chunks of the band, and classes with a
   plausible partner in another component form families; the sets of a family are compared with each
   other, leaving out what is connected already.  A family too large for one task is compared by bands and pairs of chunks instead.
4. Links give components, by minima of edge tables.

No pairs of a band are ever listed: what leaves a task connects what was found with at most one edge a class.

Edge cases: null and empty texts, and texts without words, have an empty set, no links and are their own component; a
text of fewer words than an n-gram is one n-gram; repeated rows and repeated keys are linked through the class of their text; a
row without a key takes part, its component has the smallest key among the others (null if there is none); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table
from .graph import components
from .words import mix, shingles, text_slices, word_hashes

BANDS = 40
ROWS = 5
BITS = 2
SIGMAS = 6
#: Classes of a band are compared in pairs of chunks of this many.
CHUNK = 512
#: Bounds of a family that one task compares.
MOST_ELEMENTS = 2_000_000
MOST_CLASSES = 4096
_DRAW = np.random.default_rng(20240513)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_STEPS = _DRAW.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORDS = -(-BANDS * ROWS // 64)
SLICE = 1 << 20


def text_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, text after text, and their offsets."""
    hashes, offsets = shingles(*word_hashes(texts), n)
    sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return (np.concatenate(sets) if sets else hashes), np.cumsum([0] + [len(s) for s in sets])


def class_names(grams: np.ndarray, offsets: np.ndarray) -> list[int | None]:
    """A signed 64-bit name for each set, the same for equal sets; none for an empty one."""
    spread = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)])
    sizes = np.diff(offsets)
    names = mix((spread[offsets[1:]] - spread[offsets[:-1]]) ^ mix(sizes.astype(np.uint64))).view(np.int64)
    return [int(x) if s else None for x, s in zip(names, sizes, strict=True)]


def minima(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, BANDS * ROWS) minima of non-empty sets."""
    out = np.empty((len(offsets) - 1, len(_FACTORS)), np.uint64)
    start = 0
    while start < len(out):
        # sets of some 32,000 n-grams at once stay in the cache; a longer set is taken alone, in pieces
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 15), side="right")) - 1)
        for i, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
            if end - start == 1:
                out[start, i] = min((grams[a : min(a + (1 << 15), offsets[end])] * factor + shift).min() for a in range(offsets[start], offsets[end], 1 << 15))
            else:
                out[start:end, i] = np.minimum.reduceat(grams[offsets[start] : offsets[end]] * factor + shift, offsets[start:end] - offsets[start])
        start = end
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys."""
    sums = (mix(least).reshape(len(least), BANDS, ROWS) * _STEPS).sum(2, dtype=np.uint64)
    return mix(sums + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """(sets, BITS * WORDS) words: the planes of the low bits of the minima."""
    low = np.zeros((len(least), BITS, WORDS * 64), np.uint8)
    spread = mix(least)
    for b in range(BITS):
        low[:, b, : least.shape[1]] = spread >> np.uint64(b) & np.uint64(1)
    return np.packbits(low.reshape(len(least), -1), axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(len(least), BITS * WORDS)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in which signatures (rows of words) agree."""
    differ = (x ^ y).reshape(*np.broadcast_shapes(x.shape, y.shape)[:-1], BITS, WORDS)
    return len(_FACTORS) - np.bitwise_count(np.bitwise_or.reduce(differ, axis=-2).view(np.uint64)).sum(-1, dtype=np.int64)


def estimate(places: np.ndarray) -> np.ndarray:
    """Similarity for a number of agreeing places, corrected for chance collisions."""
    chance = 0.5**BITS
    return (places / len(_FACTORS) - chance) / (1 - chance)


def least_places(percent: int, sigmas: float = SIGMAS) -> int:
    """Fewest agreeing places that a linked pair may plausibly have."""
    chance, k = 0.5**BITS, len(_FACTORS)
    share = percent / 100 * (1 - chance) + chance
    return max(0, math.floor(k * share - sigmas * math.sqrt(k * share * (1 - share))))


def agreeing_column(x: str, y: str) -> Column:
    """``agreeing`` of two columns of words."""
    out = F.lit(len(_FACTORS))
    for w in range(WORDS):
        planes = [F.col(x)[b * WORDS + w].bitwiseXOR(F.col(y)[b * WORDS + w]) for b in range(BITS)]
        differ = planes[0]
        for plane in planes[1:]:
            differ = differ.bitwiseOR(plane)
        out = out - F.bit_count(differ)
    return out


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel(), pa.int64()))


def _signatures(n: int):
    """Per text doc_id, size, class, and for the first text of a class in a batch its signature and keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            seen: set[int] = set()
            for a, b in text_slices(texts, SLICE):
                grams, offsets = text_sets(texts[a:b], n)
                names, sizes = class_names(grams, offsets), np.diff(offsets)
                first = np.zeros(b - a, bool)
                for i, name in enumerate(names):
                    if name is not None and name not in seen:
                        seen.add(name)
                        first[i] = True
                chosen = grams[np.repeat(first, sizes)]
                least = minima(chosen, np.concatenate([[0], np.cumsum(sizes[first])]))
                # rows without a signature take a null
                at = pa.array(np.where(first, np.cumsum(first) - 1, 0), mask=~first)
                planes, keys = (_lists(x).take(at) if len(x) else pa.nulls(b - a, pa.list_(pa.int64())) for x in (packed(least), band_keys(least)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(names, pa.int64()), planes, keys], names=["doc_id", "size", "class", "planes", "keys"]
                )

    return work


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold tasks whole, from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        tasks = batch.column(0).to_numpy()
        cut = int(np.searchsorted(tasks == tasks[-1], True))  # first row of the last task
        if held and tasks[0] != held[-1].column(0)[len(held[-1]) - 1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Which members are connected."""

    def __init__(self, top: np.ndarray):
        self.top = top.copy()

    def find(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = self.top[self.top[i]]
            i = int(self.top[i])
        return i

    def tie(self, i: int, j: int) -> bool:
        a, b = sorted((self.find(i), self.find(j)))
        self.top[b] = a
        return a != b


def _plausible(least: int):
    """From (task, side, class, component, planes) sorted by task: edges that connect classes with a plausible partner in another component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches):
            task, side, name, component = (table.column(i).to_numpy() for i in range(4))
            planes = table.column(4).combine_chunks().flatten().to_numpy().reshape(len(task), BITS * WORDS)
            forest = Forest(np.arange(len(task)))
            a, b = [], []
            here = np.arange(len(task))
            shift = 0
            while len(here):
                shift += 1
                here = here[here + shift < len(task)]
                here = here[task[here] == task[here + shift]]
                there = here + shift
                crossing = (component[here] != component[there]) & ((side[here] < 0) | (side[here] != side[there]))
                x, y = here[crossing], there[crossing]
                near = agreeing(planes[x], planes[y]) >= least
                for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    if forest.tie(i, j):
                        a.append(name[i])
                        b.append(name[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def _confirmed(n: int, percent: int, least: int):
    """From (task, side, class, component, planes, text) sorted by task: links that connect what full sets confirm."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches):
            tasks = table.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                part = table.slice(first, end - first)
                found = _compare(*[part.column(i).to_pylist() for i in (1, 2, 3, 4, 5)], n, percent, least)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return work


def _compare(side: list, name: list, component: list, planes: list, texts: list, n: int, percent: int, least: int) -> list[tuple[int, int]]:
    grams_of: list[np.ndarray] = []
    names: list[int | None] = []
    for a, b in text_slices(texts, SLICE):
        grams, offsets = text_sets(texts[a:b], n)
        names += class_names(grams, offsets)
        grams_of += [grams[x:y].copy() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
    # a repeated key brings texts of other classes along, and a repeated row its class twice
    own = {c: i for i, c in reversed(list(enumerate(names))) if c == name[i]}
    rows = sorted(own.values(), key=lambda i: name[i])
    if len(rows) < 2:
        return []
    sizes = np.array([len(grams_of[i]) for i in rows])
    _, number = np.unique(np.concatenate([grams_of[i] for i in rows]), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    sides, known = np.array([side[i] for i in rows]), [component[i] for i in rows]
    words = np.array([planes[i] for i in rows], np.int64)
    starts: dict[int, int] = {}
    forest = Forest(np.array([starts.setdefault(c, i) for i, c in enumerate(known)]))
    has = np.zeros(int(number.max()) + 1, bool)
    links = []
    top = np.array([forest.find(i) for i in range(len(rows))])
    for i in range(len(rows) - 1):
        others = np.arange(i + 1, len(rows))
        fits = (top[others] != top[i]) & ((sides[i] < 0) | (sides[others] != sides[i]))
        fits &= (sizes[others] * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes[others])
        others = others[fits]
        others = others[agreeing(words[others], words[i]) >= least]
        if not len(others):
            continue
        mine = number[offsets[i] : offsets[i + 1]]
        has[mine] = True
        shared = np.array([np.count_nonzero(has[number[offsets[j] : offsets[j + 1]]]) for j in others])
        has[mine] = False
        linked = others[100 * shared >= percent * (sizes[i] + sizes[others] - shared)]
        for j in linked.tolist():
            if top[i] != top[j]:
                links.append((name[rows[i]], name[rows[j]]))
                top[top == top[j]] = top[i]
    return links


def _grams(n: int):
    """From (doc_id, text, class, hub): class, hub and the set of the text, if it is of that class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            seen: set[int] = set()
            for a, b in text_slices(texts, SLICE):
                grams, offsets = text_sets(texts[a:b], n)
                rows = []
                for i, name in enumerate(class_names(grams, offsets)):
                    if name == wanted[a + i] and name not in seen:
                        seen.add(name)
                        rows.append(i)
                sets = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(grams.view(np.int64))).take(pa.array(rows, pa.int64()))
                picked = [batch.column(c).slice(a, b - a).take(pa.array(rows, pa.int64())) for c in (2, 3)]
                yield pa.RecordBatch.from_arrays([*picked, sets], names=["class", "hub", "grams"])

    return work


def _with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with the column ``row``, a key that may be null) with the texts of that key."""
    there = rows.select(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))).alias("at"), "text")
    keyed = wanted.withColumn("at", F.struct(F.col("row").isNull(), F.coalesce("row", F.lit(0)))).drop("row")
    # what is wanted grows with the table: never broadcast, also where it is small by chance
    return there.join(keyed.hint("merge"), "at").drop("at")


def join(docs: DataFrame, n: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text", most_elements: int = MOST_ELEMENTS,
         most_classes: int = MOST_CLASSES, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (smallest key reachable by links, itself included), kept."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, size long, class long, planes array<long>, keys array<long>"
    signed = cut_lineage(rows.mapInArrow(_signatures(n), schema))
    one = signed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("row"), F.first("size").alias("size"))
    # texts with an empty set have no class; a class is named once for each batch that it is in
    banded = signed.where("keys IS NOT NULL").select("class", F.explode("keys").alias("band"))
    ends = banded.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    members = cut_lineage(banded.join(ends.select("band", "low"), "band").distinct())
    planes = signed.where("planes IS NOT NULL").select("class", "planes").dropDuplicates(["class"])
    least = least_places(percent)
    stars = _star_links(rows, members, planes, one, n, percent, least)
    found = _family_links(rows, members, planes, one, stars, n, percent, least, most_elements, most_classes, chunk)
    joined = components(stars.union(found))
    named = signed.select("doc_id", "size", "class").join(joined.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("top", F.coalesce("component", "class"))
    tops = named.where("class IS NOT NULL").groupBy("top").agg(F.min("doc_id").alias("smallest"))
    out = named.join(tops, "top", "left").withColumn("component_id", F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _star_links(rows, members, planes, one, n, percent, least) -> DataFrame:
    """Confirmed links (a, b) of classes with the smallest class of one of their bands: the one whose signature is nearest."""
    edges = members.where("class <> low").select(F.col("class").alias("b"), F.col("low").alias("a")).distinct()
    edges = edges.join(planes.select(F.col("class").alias("b"), F.col("planes").alias("own")), "b")
    edges = edges.join(planes.select(F.col("class").alias("a"), "planes"), "a")
    edges = edges.select("a", "b", agreeing_column("own", "planes").alias("places")).where(F.col("places") >= least)
    nearest = cut_lineage(edges.groupBy("b").agg(F.max_by("a", F.struct("places", "a")).alias("a")))
    hubs = nearest.select(F.col("a").alias("class"), F.lit(None).cast("long").alias("hub")).distinct()
    wanted = nearest.select(F.col("b").alias("class"), F.col("a").alias("hub")).union(hubs).join(one.select("class", "row"), "class")
    sets = _with_texts(rows, wanted)
    sets = cut_lineage(sets.select(F.lit(0).alias("doc_id"), "text", "class", "hub").mapInArrow(_grams(n), "class long, hub long, grams array<long>"))
    spokes = sets.where("hub IS NOT NULL").select("hub", "class", "grams")
    centres = sets.where("hub IS NULL").select(F.col("class").alias("hub"), F.col("grams").alias("others"))
    both = spokes.join(centres.hint("merge"), "hub")
    shared = F.size(F.array_intersect("grams", "others"))
    linked = 100 * shared >= percent * (F.size("grams") + F.size("others") - shared)
    links = cut_lineage(both.where(linked).select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct())
    drop_table(sets)
    return links


def _family_links(rows, members, planes, one, stars, n, percent, least, most_elements, most_classes, chunk) -> DataFrame:
    """Confirmed links (a, b) between components of ``stars``."""
    labels = components(stars).withColumnRenamed("node", "class")
    labelled = members.select("band", "class").join(labels, "class", "left").select("band", "class", F.coalesce("component", "class").alias("component"))
    labelled = cut_lineage(labelled)
    mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y")
    open_ = cut_lineage(labelled.join(mixed.select("band", "n"), "band"))
    tasks = _chunk_pairs(open_, chunk)
    ties = tasks.join(planes, "class").select("task", "side", "class", "component", "planes").repartition("task").sortWithinPartitions("task")
    ties = cut_lineage(ties.mapInArrow(_plausible(least), "a long, b long").distinct())
    families = components(ties)
    inside = families.select(F.col("node").alias("class"), F.col("component").alias("family")).join(one, "class").join(labels, "class", "left")
    inside = cut_lineage(inside.withColumn("component", F.coalesce("component", "class")))
    weights = inside.groupBy("family").agg(F.sum("size").alias("elements"), F.count("*").alias("classes"))
    small = (F.col("elements") <= most_elements) & (F.col("classes") <= most_classes)
    weighed = inside.join(weights, "family").withColumn("small", small)
    groups = weighed.where("small").select(F.col("family").alias("task"), F.lit(-1).alias("side"), "class", "component", "row")
    large = weighed.where("NOT small").select("class", "row")
    # a large family: the classes of each band that are in it, in pairs of chunks
    again = open_.drop("n").join(large.select("class"), "class")
    again = again.join(again.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")
    groups = groups.union(_chunk_pairs(again, chunk).join(large, "class").select("task", "side", "class", "component", "row"))
    ready = _with_texts(rows, groups.join(planes, "class"))
    ready = ready.select("task", "side", "class", "component", "planes", "text").repartition("task").sortWithinPartitions("task")
    return cut_lineage(ready.mapInArrow(_confirmed(n, percent, least), "a long, b long").distinct())


def _chunk_pairs(banded: DataFrame, chunk: int) -> DataFrame:
    """task, side, class, component: each pair of chunks of a band is a task; sides are 0 and 1, or -1 where a chunk meets itself."""
    dealt = banded.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, -1).when(F.col("part") == low, 0).otherwise(1)
    return dealt.select(F.xxhash64("band", low, high).alias("task"), side.alias("side"), "class", "component")
