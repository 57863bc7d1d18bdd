"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the document's, sketches of parts merge by union, and the share
of one sketch found in another estimates containment even between a page and a
book.  The smallest hash is always kept, so that only a text without words has
an empty sketch.

Hashes have 48 bits and are written as 12 hexadecimal digits each, ascending.

Edge cases: null counts as empty; a text of fewer words than a shingle is one
shingle; two empty sketches are alike (1.0), an empty and another one not (0.0);
repeated rows get equal results; ties of the key are ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import shingles, text_slices, word_hashes

SHINGLE = 5
SCALE = 4
BITS = 48
BUCKET_ROWS = 256
MOST_BUCKETS = 20_000


def sketches(texts: list[str | None], k: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """Sorted distinct retained hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in text_slices(texts):
        hashes, offsets = shingles(*word_hashes(texts[a:b]), k)
        hashes >>= np.uint64(64 - BITS)
        keep = hashes < np.uint64((1 << BITS) // scale)
        for i in range(b - a):
            own = hashes[offsets[i] : offsets[i + 1]]
            if len(own):
                kept = own[keep[offsets[i] : offsets[i + 1]]]
                out.append(np.unique(kept if len(kept) else own.min(keepdims=True)))
            else:
                out.append(own)
    return out


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of two texts together (but for shingles across their border)."""
    both = np.union1d(a, b)
    low = both[both < np.uint64((1 << BITS) // scale)]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller document's shingles that the other has."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex()


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next_text: the next document by ascending key (null keys first, ties by text), after the last the first.

    The key range is cut at keys that occur in the table, so the neighbour across
    a cut is known: the row at a cut goes to its own range and, marked, to the
    end of the range before it.  Texts are shuffled once.  There are about
    ``BUCKET_ROWS`` rows in a range, and at most ``MOST_BUCKETS`` ranges, whose
    first keys are all that the driver sees.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(1, min(MOST_BUCKETS, rows.count() // BUCKET_ROWS))
    at = [i / n for i in range(1, n)]
    low, cuts = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", at, max(10_000, 10 * n)) if at else F.lit(None)).first()
    has_null = rows.where("doc_id IS NULL").limit(1).count() > 0
    cuts = sorted({c for c in cuts or [] if has_null or c > low} | ({low} if has_null and low is not None else set()))
    if cuts:
        bounds = F.array(*[F.lit(c) for c in cuts]) if len(cuts) < 50 else F.from_json(F.lit(str(cuts)), "array<bigint>")
        # number of cuts at or below the key: position of the key among the sorted cuts
        home = F.when(F.col("doc_id").isNull(), 0).otherwise(_rank(F.col("doc_id"), bounds, len(cuts)))
    else:
        home = F.lit(0)
    first = None if has_null else low
    before = F.when(F.col("doc_id").eqNullSafe(F.lit(first)), F.lit(len(cuts)))
    if cuts:
        before = before.when(F.array_contains(bounds, F.col("doc_id")), F.col("home") - 1)
    placed = rows.withColumn("home", home).withColumn("ghost_of", before)
    both = placed.select(
        "doc_id", "text", "home",
        F.explode(F.when(F.col("ghost_of").isNull(), F.array(F.lit(None).cast("int")))
                  .otherwise(F.array(F.lit(None).cast("int"), F.col("ghost_of").cast("int")))).alias("ghost"),
    )
    both = both.select("doc_id", "text", F.coalesce("ghost", F.col("home").cast("int")).alias("range"), F.col("ghost").isNotNull().alias("is_ghost"))
    order = Window.partitionBy("range").orderBy("is_ghost", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next_text", F.lead("text").over(order)).where("NOT is_ghost").select("doc_id", "text", "next_text")


def _rank(value, bounds, n: int):
    """How many of the ``n`` sorted bounds are at or below the value, by halving."""

    def advance(at, step: int):
        # the lambda names the place so far, so each step's expression holds the one before it only once
        higher = lambda x: x + F.when((x + step <= n) & (F.get(bounds, x + step - 1) <= value), step).otherwise(0)
        return F.transform(F.array(at), higher)[0]

    at = F.lit(0)
    for step in (1 << k for k in reversed(range(n.bit_length()))):
        at = advance(at, step)
    return at


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_kept long"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, nexts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in text_slices(texts, 2 << 20):
            own, following = texts[a:b], [t or "" for t in nexts[a:b]]
            edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(own, following, strict=True)]
            # a text's successor is mostly the next one in the slice
            mine, changed = sketches(own), sketches(edited)
            after = [mine[i + 1] if i + 1 < b - a and own[i + 1] == f else sketches([f])[0] for i, f in enumerate(following)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                    pa.array([written(s) for s in mine], pa.string()),
                    pa.array([written(s) for s in changed], pa.string()),
                    pa.array([containment(x, y) for x, y in zip(mine, changed, strict=True)], pa.float64()),
                    pa.array([containment(x, y) for x, y in zip(mine, after, strict=True)], pa.float64()),
                    pa.array([len(s) for s in mine], pa.int64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_kept"],
            )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketch of every text, of its edited text, and their likenesses (columns of ``RESULT``)."""
    return with_next(docs, key, text).mapInArrow(_compare, RESULT)
