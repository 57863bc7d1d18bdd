"""Repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts somewhere else is removed.

A corpus is too long to sort its suffixes, but only few of its strings repeat, and
where they may is found without loss from anchors:

1. Each string of ``LENGTH`` bytes has an anchor: the (leftmost) least hash among its runs of
   ``GRAM`` bytes.  Equal strings have equal anchors at equal places, so a string
   can only repeat where its anchor occurs twice.  Anchors are counted over all texts.
2. The strings that share one anchor place follow each other; the bytes from the
   first string's start to the last one's end are its *context*.  Contexts of
   repeated anchors are dealt into shards by anchor.  Contexts equal in a batch are
   sent once (all their strings repeat), so copies do not pile up.
3. In a shard, a run-length index: the Burrows-Wheeler transform of all distinct contexts,
   compressed to its runs.  Matching statistics are taken only at the ends of runs, where they are not
   implied by the place before: inside a run the match of a place is one shorter than that of
   the place to its left.  That gives each place's longest match with any other place,
   and places whose match reaches ``LENGTH`` are marked.  Within a shard no place's
   string occurs in two contexts by itself, so a match is always another occurrence.
4. An anchor that occurs more than ``HOT`` times would fill a shard: its strings are
   sent one by one as 16-byte digests, dealt by digest and also combined in each batch.
5. Marked strings become byte ranges, which meet the texts again.

Edge cases: null counts as empty; a text shorter than ``LENGTH`` keeps all its
bytes; repeated rows repeat each other; keys need not be unique (rows are known by key and
hash of the text); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import _powers, mix, slices

LENGTH = 200
GRAM = 32
HOT = 5000
SHARD_CONTEXTS = 5000
SLICE = 1 << 19
PACKED = 7  # symbols of nine bits in a number
_PLACE = np.uint64((1 << 24) - 1)


def _anchor_runs(raws: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, anchor hashes, first starts, last starts) of the strings of each text that share an anchor place."""
    parts = []
    for i, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, SLICE):
            parts.append((i, at, raw[at : at + SLICE + length - 1]))
    for a, b in slices([len(p) for _, _, p in parts], SLICE):
        own = parts[a:b]
        sizes = np.array([len(p) for _, _, p in own])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(p for _, _, p in own), np.uint8)
        n = len(data)
        up, down = _powers(1 << max(21, n.bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
        hashes = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        wide = length - gram + 1
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:]) if len(least) > span else least
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        starts = np.concatenate([np.arange(o, o + s - length + 1) for o, s in zip(offsets[:-1], sizes, strict=True)])
        part = np.repeat(np.arange(len(own)), sizes - length + 1)
        place = (least[starts] & _PLACE).astype(np.int64)
        edge = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        first, last = starts[edge], starts[np.append(edge[1:], len(starts)) - 1]
        of = part[edge]
        cut = np.searchsorted(of, np.arange(len(own) + 1))
        for k, (i, at, _) in enumerate(own):
            x, y = cut[k], cut[k + 1]
            shift = at - offsets[k]
            yield i, hashes[place[edge[x:y]]].view(np.int64), first[x:y] + shift, last[x:y] + shift


def run_index(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of the concatenated contexts (each behind with a separator of its own), and the contexts' offsets.

    The value of a place is the length of the longest string from it that also
    starts at another place.
    """
    sizes = np.array([len(c) for c in contexts])
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(offsets[-1])
    text = np.empty(n, np.int32)
    text[:] = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text[offsets[1:] - 1] = 256 + np.arange(len(contexts))
    left_over = (np.repeat(offsets[1:], sizes + 1) - 1 - np.arange(n)).astype(np.int32)  # up to the separator
    # the first symbols of each suffix as one number; a separator is 256 there, and what is behind it 0
    first = np.minimum(text, 256).astype(np.int64)
    symbols = first.astype(np.int16)
    for k in range(1, PACKED):
        first <<= 9
        reaches = left_over[: max(0, n - k)] >= k
        first[: len(reaches)] |= np.where(reaches, symbols[k:], np.int16(0))
    del symbols
    # ranks by ever longer prefixes, until all suffixes are told apart; a rank is the place of the first suffix of that prefix
    order = np.argsort(first)  # equal keys get one rank, so it need not be stable
    closed = left_over[order] < PACKED
    among = np.flatnonzero(closed)
    ties = order[among]
    order[among] = ties[np.lexsort((ties, first[ties]))]  # separators ascend with their places
    head = closed
    head[0] = True
    head[1:] |= np.diff(first[order]) != 0
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    levels: list[tuple[int, np.ndarray]] = []
    width = PACKED
    at = np.flatnonzero(~(head & np.append(head[1:], True)))  # only prefixes that several suffixes have are ranked further
    while len(at):
        levels.append((width, rank))
        places = order[at]
        key = rank[places] * np.int64(n) + rank[places + width]
        by = np.argsort(key)
        key, places = key[by], places[by]
        order[at] = places
        head = np.diff(key, prepend=-1) != 0
        rank = rank.copy()
        rank[places] = np.maximum.accumulate(np.where(head, at, 0))
        width *= 2
        at = at[~(head & np.append(head[1:], True))]
    del rank
    transform = text[order - 1]
    ends = np.flatnonzero(np.diff(transform) != 0)  # run ends: places k with another symbol at k + 1
    del text, transform
    one, other = order[ends], order[ends + 1]
    del order
    matched = np.zeros(len(ends), np.int32)
    for size, ranks in reversed(levels):
        same = ranks[one + matched] == ranks[other + matched]
        matched[same] += size
    differ = first[one + matched] ^ first[other + matched]
    for k in range(1, PACKED):
        matched += differ < 1 << 9 * k
    matched += differ == 0
    np.minimum(matched, np.minimum(left_over[one], left_over[other]), out=matched)
    # a match reaches as far from the places behind its first; what the ends of runs imply is all there is
    reach = np.zeros(n, np.int32)
    reach[one] = one + matched  # with the next suffix
    reach[other] = np.maximum(reach[other], other + matched)  # with the previous suffix
    out = np.maximum.accumulate(reach) - np.arange(n, dtype=np.int32)
    return np.maximum(out, 0, out=out), offsets


def _ranges(marked: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of set places, end exclusive."""
    edge = np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


# ---- Spark

_ROW = "rid long, sig long"


def _count_anchors(length: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = _bytes_of(batch.column(2))
            for a, b in slices([len(r) for r in raws], 8 << 20):
                rows, anchors, counts = [], [], []
                for i, hashes, _, _ in _anchor_runs(raws[a:b], length, gram):
                    own, n = np.unique(hashes, return_counts=True)
                    rows.append(np.full(len(own), a + i))
                    anchors.append(own)
                    counts.append(n)
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(anchors)), pa.array(np.concatenate(counts).astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)],
                        names=["anchor", "n", "rid", "sig"],
                    )

    return work


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _send_contexts(length: int, gram: int, shards: int):
    """Rows for the shards: contexts (kind 0) and digests of single strings (1), each with whether it
    is already known to repeat, and finished ranges (2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, sigs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raws, wanted, hot = _bytes_of(batch.column(2)), batch.column(3), batch.column(4)
            for a, b in slices([len(r) for r in raws], 8 << 20):
                found: dict[tuple[int, bytes], tuple[int, list]] = {}
                cache: dict[int, tuple[np.ndarray, set]] = {}
                for i, hashes, first, last in _anchor_runs(raws[a:b], length, gram):
                    if i not in cache:
                        cache = {i: (np.array(wanted[a + i].as_py(), np.int64), set(hot[a + i].as_py()))}
                    some, many = cache[i]
                    raw, row = raws[a + i], (rids[a + i], sigs[a + i])
                    for k in np.flatnonzero(np.isin(hashes, some)).tolist():
                        h, lo, hi = int(hashes[k]), int(first[k]), int(last[k])
                        if h not in many:
                            found.setdefault((0, raw[lo : hi + length]), (h, []))[1].append((*row, lo, hi))
                        else:
                            for at in range(lo, hi + 1):
                                digest = hashlib.blake2b(raw[at : at + length], digest_size=16).digest()
                                found.setdefault((1, digest), (int.from_bytes(digest[:7], "big"), []))[1].append((*row, at, at))
                yield _sent(found, length, shards)

    return work


_SENT = "shard int, kind int, body binary, known boolean, rid long, sig long, lo int, hi int"


def _sent(found: dict, length: int, shards: int) -> pa.RecordBatch:
    rows = []
    for (kind, body), (h, places) in found.items():
        rid, sig, lo, hi = places[0]
        rows.append((h % shards, kind, body, len(places) > 1, rid, sig, lo, hi))
        if len(places) > 1:
            rows += [(s % shards, 2, b"", True, r, s, x, y + length) for r, s, x, y in places]
    columns = list(zip(*rows, strict=True)) or [()] * 8
    types = (pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])


def _match_shard(length: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows[rows["kind"] == 2]
        out = [done[["rid", "sig", "lo", "hi"]]]
        digests = rows[rows["kind"] == 1]
        if len(digests):
            same = digests.groupby("body")["known"].transform("size") > 1
            hit = digests[same & ~digests["known"]]
            out.append(hit.assign(hi=hit["hi"] + length)[["rid", "sig", "lo", "hi"]])
        contexts = rows[rows["kind"] == 0]
        if len(contexts):
            number: dict[bytes, int] = {}
            of = [number.setdefault(c, len(number)) for c in contexts["body"]]
            many = np.bincount(of, minlength=len(number))
            np.maximum.at(many, of, np.where(contexts["known"], 2, 1))
            bodies = list(number)
            stats, offsets = run_index(bodies)
            ranges = np.array(_ranges(stats >= length), np.int64).reshape(-1, 2)  # none goes over a separator
            cut = np.searchsorted(ranges[:, 0], offsets).tolist()
            marks: list[list[list[int]]] = []
            for i, body in enumerate(bodies):
                n = len(body) - length + 1
                marks.append([[0, n]] if many[i] > 1 else (ranges[cut[i] : cut[i + 1]] - offsets[i]).tolist())
            found = [
                (rid, sig, lo + x, lo + y - 1 + length)
                for i, known, rid, sig, lo in zip(of, contexts["known"], contexts["rid"], contexts["sig"], contexts["lo"], strict=True)
                if not known
                for x, y in marks[i]
            ]
            out.append(pd.DataFrame(found, columns=["rid", "sig", "lo", "hi"]))
        return pd.concat(out).astype({"rid": "int64", "sig": "int64", "lo": "int32", "hi": "int32"})

    return work


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_ranges(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes outside the ranges, number of bytes removed, number of maximal runs removed)."""
    kept, at, spans = [], 0, 0
    for s, e in sorted(ranges):
        if s > at or not spans:
            kept.append(raw[at:s])
            spans += 1
        at = max(at, e)
    body = b"".join([*kept, raw[at:]])
    return body, len(raw) - len(body), spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, los, his in zip(_bytes_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            body, removed, spans = cut_ranges(raw, list(zip(los or [], his or [], strict=True)))
            rows.append((len(raw), removed, spans, hashlib.sha256(body).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))],
            names=[c.split()[0] for c in RESULT.split(", ")],
        )


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the columns of ``RESULT``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key), F.lit(-1)).cast("long").alias("rid"),
                       F.xxhash64(F.col(key).isNull(), whole).alias("sig"), whole.alias("text"))
    counted = rows.select("rid", "sig", "text").mapInArrow(_count_anchors(length, gram), f"anchor long, n int, {_ROW}")
    everywhere = counted.withColumn("total", F.sum("n").over(Window.partitionBy("anchor"))).where("total > 1")
    repeated = cut_lineage(everywhere.select("anchor", "rid", "sig", (F.col("total") > hot).alias("hot")))
    shards = max(16, repeated.count() // SHARD_CONTEXTS)
    wanted = repeated.groupBy("rid", "sig").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    # one shuffle of the texts serves both joins
    texts = rows.repartition("rid", "sig")
    sent = texts.join(wanted, ["rid", "sig"]).select("rid", "sig", "text", "anchors", "hot").mapInArrow(_send_contexts(length, gram, shards), _SENT)
    found = sent.groupBy("shard").applyInPandas(_match_shard(length), "rid long, sig long, lo int, hi int")
    ranges = found.groupBy("rid", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return texts.join(ranges, ["rid", "sig"], "left").select(
        "doc_id", "text", F.col("ranges.lo").alias("los"), F.col("ranges.hi").alias("his")
    ).mapInArrow(_cut, RESULT)
