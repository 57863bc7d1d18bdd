"""Vector code compression: product codes whose codebooks are fitted by active-entry Lloyd rounds.

Vectors become whole numbers and are cut into parts; each part position has a
codebook, and a vector's code is the number of the nearest entry at each position.  All
arithmetic is in whole numbers, so every run gives the same codes.

Rounds keep with each part its entry and the exact squared distance to it.  After an update
only some entries have moved.  A part whose entry did not move compares its stored distance
with the moved entries alone: those at rest were no better before and are no better now.  A part
whose entry moved looks at all entries.  Ties go to the lower index in both cases.  When no entry
moves, the rounds that are left would change nothing.

A round is one pass over the table of the round before, written as a table with the partial
sums of each batch next to the rows; only sums by entry and component (bounded by entries times
components) come to the driver, and only codebooks go back.  A round's table is dropped once the
next is written.

Edge cases: rows whose vector is null, empty, or holds null or non-finite components leave, and so do those of
another length than the most common one (of equally common ones the smallest); parts differ by one component where the length is not a
multiple of their number; scaled components are held to +-2^26 so that no sum overflows; repeated ids
seed one entry (the least of their vectors), a null id comes after all others; fewer ids than entries give smaller codebooks; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, drop_table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Largest component of a scaled vector.
LARGEST = 1 << 26
#: Labels are joined to their sums in this many pieces, as one may hold a large share of all rows.
SALTS = 16
SLICE = 2_000_000


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and the scaled components of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where((F.size("vector") > 0) & finite)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    held = F.transform("vector", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale))).cast("int"))
    return rows.select("vec_id", "label", held.alias("parts"))


class Codebooks:
    """Entries of each part position, and which of them moved in the last update."""

    def __init__(self, entries: list[np.ndarray], moved: list[np.ndarray] | None = None):
        self.entries = entries
        self.moved = moved or [np.ones(len(e), bool) for e in entries]

    @classmethod
    def seeded(cls, vectors: list[list[int]], parts: int) -> Codebooks:
        table = np.array(vectors, np.int64)
        cuts = [p * table.shape[1] // parts for p in range(parts + 1)]
        return cls([table[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries become the floored means of their parts; unused ones stay."""
        entries, at = [], 0
        for p, old in enumerate(self.entries):
            size = old.size
            total = sums[at : at + size].reshape(old.shape)
            at += size
            count = counts[p * len(old) : (p + 1) * len(old), None]
            entries.append(np.where(count > 0, total // np.maximum(count, 1), old))
        return Codebooks(entries, [(new != old).any(1) for new, old in zip(entries, self.entries, strict=True)])

    def assign(self, rows: np.ndarray, codes: np.ndarray, distances: np.ndarray, known: bool) -> None:
        """Bring codes and distances (rows by parts) up to date in place; ``known`` if they hold for the codebooks before."""
        at = 0
        for p, entries in enumerate(self.entries):
            points = rows[:, at : at + entries.shape[1]]
            at += entries.shape[1]
            stays = ~self.moved[p][codes[:, p]] if known else np.zeros(len(rows), bool)
            for where, candidates in ((stays, np.flatnonzero(self.moved[p])), (~stays, np.arange(len(entries)))):
                if not where.any() or not len(candidates):
                    continue
                own = points[where]
                code = codes[where, p] if where is stays else np.full(len(own), len(entries), np.int64)
                best = distances[where, p] if where is stays else np.full(len(own), np.iinfo(np.int64).max)
                for j in candidates:
                    far = ((own - entries[j]) ** 2).sum(1)
                    nearer = (far < best) | ((far == best) & (j < code))
                    code, best = np.where(nearer, j, code), np.where(nearer, far, best)
                codes[where, p], distances[where, p] = code, best

    def sums(self, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Sums by part, entry and component, then counts by part and entry."""
        out, counts, at = [], [], 0
        for p, entries in enumerate(self.entries):
            points = rows[:, at : at + entries.shape[1]]
            at += entries.shape[1]
            out += [points[codes[:, p] == j].sum(0) for j in range(len(entries))]
            counts.append(np.bincount(codes[:, p], minlength=len(entries)))
        return np.concatenate(out + counts)

    def digest(self) -> str:
        text = ",".join(str(x) for e in self.entries for x in e.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def _step(books: Codebooks, known: bool):
    """One round over rows (vec_id, label, parts, codes, distances, sums); a row with sums alone follows each slice of a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books.entries)
        width = sum(e.shape[1] for e in books.entries)
        for whole in batches:
            if known:
                whole = whole.filter(whole.column(2).is_valid())
            for a in range(0, len(whole), max(1, SLICE // width)):
                batch = whole.slice(a, max(1, SLICE // width))
                n = len(batch)
                rows = batch.column(2).flatten().to_numpy().astype(np.int64).reshape(n, width)
                if known:
                    codes, far = (batch.column(i).flatten().to_numpy().astype(np.int64).reshape(n, parts) for i in (3, 4))
                else:
                    codes, far = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
                books.assign(rows, codes, far, known)
                lists = [pa.ListArray.from_arrays(np.arange(0, n * parts + 1, parts, dtype=np.int32), pa.array(x.ravel(), k)) for x, k in ((codes, pa.int32()), (far, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists, pa.nulls(n, pa.list_(pa.int64()))], names=NAMES)
                alone = [pa.nulls(1, batch.column(i).type) for i in range(3)] + [pa.nulls(1, x.type) for x in lists]
                yield pa.RecordBatch.from_arrays([*alone, pa.array([books.sums(rows, codes)], pa.list_(pa.int64()))], names=NAMES)

    return work


NAMES = ["vec_id", "label", "parts", "codes", "distances", "sums"]


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Rows of ``whole_vectors`` with their codes and squared distances after ``rounds`` rounds, and the codebooks."""
    kinds = {f.name: f.dataType for f in rows.schema}
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(c, t) for c, t in zip(NAMES, [kinds["vec_id"], kinds["label"], kinds["parts"], T.ArrayType(T.IntegerType()), longs, longs], strict=True)])
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None])
    chosen = chosen | F.col("vec_id").isNull() if None in ids else chosen
    seeds = {r[0]: r[1] for r in rows.where(chosen).groupBy("vec_id").agg(F.min("parts")).collect()}
    if not ids:
        return rows.sparkSession.createDataFrame([], schema), Codebooks([])
    books = Codebooks.seeded([seeds[i] for i in ids], parts)
    now = cut_lineage(rows.mapInArrow(_step(books, known=False), schema))
    for _ in range(rounds):
        added = now.where("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        total = np.zeros(len(added), np.int64)
        for r in added:
            total[r["pos"]] = r["n"]
        split = sum(e.size for e in books.entries)
        books = books.updated(total[:split], total[split:])
        if not any(m.any() for m in books.moved):
            break
        after = cut_lineage(now.mapInArrow(_step(books, known=True), schema))
        drop_table(now)
        now = after
    return now.where("parts IS NOT NULL").drop("sums"), books


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and the digest of the codebooks."""
    found, books = fit(whole_vectors(vectors, key, vector, label), **options)
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    rows = found.select("vec_id", F.col("label").alias("kind"), F.array_join(digits, "").alias("code"), F.aggregate("distances", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"))
    sums = rows.groupBy(F.col("kind").alias("of")).agg(F.sum("error").alias("label_error")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(sums, (F.col("salt") == F.col("piece")) & F.col("kind").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
