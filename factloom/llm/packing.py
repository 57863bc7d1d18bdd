"""Packing token ids into sequences without changing their order.

Documents of a partition form one stream of ids.  Windows are cut from it by
dynamic programming: cuts may fall at document ends (free), at sentence ends (a
small penalty) and, where a text has no sentence end for long, at regular places
(a larger penalty).  The cost of a window is its padding; a window of exactly a
power of two has none.  With f(j) the least cost of a cut at place j,

    f(j) = penalty(j) + overhead + min over i in reach of f(i) + padding(j - i)

and padding falls by one with every id, so the minimum is that of f(i) + i over
a sliding window of places, kept by a monotone queue: linear time.  Texts are
worked on in slices of ``SLICE`` characters; ids behind the last cut of a slice
go into the next one, so memory is bounded and no window is lost at a border.

Nothing is shuffled: each partition packs its own documents in their order, and
sequence numbers carry the partition's number.  A repeated run over the same
partitions gives the same pieces, also after an executor is lost.

Edge cases: null and empty texts are the end id alone; a text without any cut
place is cut at regular places; repeated rows are packed each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

WINDOW = 2048
END_ID = 1
SLICE = 4 << 20
BLOCK = 1 << 20
SENTENCE_PENALTY = 2
FORCED_PENALTY = 24
OVERHEAD = 8
FORCED_GAP = 256
FORCED_STEP = 128
SMALLEST_POWER = 256
CACHE_WORDS = 600_000
RUN_WORDS = 500
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a byte of a word is: 0 leaves the word whole, 1 a letter (0xC3 begins those from U+00C0 to U+00FF), 2 a digit, 3 a mark.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[ord("'")]] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 13, 32]] = True


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of strings without nulls."""
    _, offsets, data = strings.buffers()
    if not len(strings) or data is None:
        return np.zeros(len(strings) + 1, np.int32), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def _strings(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _listed(values: pa.Array) -> list:
    # several times faster than to_pylist, which makes an Arrow scalar of each
    return values.to_numpy(zero_copy_only=False).tolist()


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in a row, and the n + 1 offsets of the texts in them."""
    offsets, raw = _buffers(texts)
    gap = _GAP[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] = ~gap[edge]
    last[edge - 1] = ~gap[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    return _strings(ends, raw[~gap], pa.string()), np.searchsorted(starts, offsets)


def _parts(words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts that the tokenizer splits words into, in lower case; the places in them of the parts
    of all words, in a row; and the n + 1 offsets of the words in these.

    Parts are runs of letters up to U+00FF, single digits and runs of other ASCII marks.  Any other word, or one
    with an apostrophe or the beginning of a special token, is a part as it is.
    """
    offsets, raw = _buffers(words)
    kind, low = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    follow = raw[lead + 1]
    low[lead[(follow <= 0x9E) & (follow != 0x97)] + 1] += 32
    start = np.ones(len(raw), bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == 2
    special = (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    odd = np.concatenate([np.flatnonzero(kind == 0), lead[(follow == 0x97) | (follow == 0xB7)], np.flatnonzero(special)])
    if len(odd):
        whole = np.zeros(len(words), bool)
        whole[np.searchsorted(offsets, odd, side="right") - 1] = True
        whole = np.repeat(whole, np.diff(offsets))
        start &= ~whole
        low = np.where(whole, raw, low)
    start[offsets[:-1]] = True
    bounds = np.append(np.flatnonzero(start), len(raw))
    found = _strings(bounds, low, pa.string()).dictionary_encode()
    return _listed(found.dictionary), found.indices.to_numpy(), np.searchsorted(bounds, offsets)


class Encoder:
    """Little-endian id bytes of texts.

    The tokenizer's steps (normal form, lower case, splitting, merges) never reach
    across white space, so a text's ids are those of its words in a row.  The
    distinct words of a block are looked up, and those not kept are split into the
    parts that the tokenizer splits them into.  Words and parts repeat: the ids of
    parts are kept, up to ``CACHE_WORDS`` of them; those of a word with capitals or
    marks are put together from them in each block, so a word is kept in one form.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        ids = self.tokenizer.get_vocab()
        self.sentence_end = np.zeros(max(ids.values()) + 1, bool)
        self.word_end = np.zeros(len(self.sentence_end), bool)
        for token, i in ids.items():
            self.word_end[i] = token.endswith("</w>")
            self.sentence_end[i] = self.word_end[i] and token.removesuffix("</w>")[-1:] in (".", "!", "?")

    def _ids(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _run(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, which are encoded in one go: each ends with its only id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.word_end[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._ids(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        parts, _, _ = _parts(pa.array(words, pa.string()))
        new = [p for p in parts if p not in self.known]
        letters = [p for p in new if p.isalpha() and (p.isascii() or max(p) <= "\u00ff")]
        for at in range(0, len(letters), RUN_WORDS):
            run = letters[at : at + RUN_WORDS]
            self.known.update(zip(run, self._run(run), strict=True))
        others = list(set(new).difference(letters))
        self.known.update(zip(others, self._ids(others), strict=True))

    def _composed(self, words: pa.Array) -> pa.Array:
        """Ids of words that are put together from parts, learned where they are missing."""
        parts, places, offsets = _parts(words)
        ids = list(map(self.known.get, parts))
        if None in ids:
            missing = np.zeros(len(words), bool)
            missing[np.searchsorted(offsets, np.flatnonzero(np.array([i is None for i in ids])[places]), side="right") - 1] = True
            self._learn(_listed(words.filter(pa.array(missing))))
            ids = list(map(self.known.__getitem__, parts))
        ends, data = _buffers(pa.array(ids, pa.binary()).take(pa.array(places)))
        return _strings(ends[offsets], data, pa.binary())

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text (null: none), worked out for about ``BLOCK`` bytes at a time."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())).fill_null("")
        sizes = pc.binary_length(texts).to_numpy().tolist()
        return [ids for a, b in slices(sizes, BLOCK) for ids in self._block(texts.slice(a, b - a))]

    def _block(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        words, offsets = _words(texts)
        found = words.dictionary_encode()
        words, places = found.dictionary, found.indices.to_numpy()
        ids = pa.array(map(self.known.get, _listed(words)), pa.binary())
        if ids.null_count:
            rest = np.flatnonzero(ids.is_null())
            order = np.arange(len(words))
            order[rest] = len(words) + np.arange(len(rest))
            ids = pa.concat_arrays([ids, self._composed(words.take(pa.array(rest)))])
            places = order[places]
        ends, data = _buffers(ids.take(pa.array(places)))
        raw = data.tobytes()
        ends = ends[offsets].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


class Stretch(NamedTuple):
    """Consecutive ids of one document, not packed yet."""

    doc: object
    start: int
    total: int
    ids: bytes


def cut_places(stretches: list[Stretch], sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the stream where a window may end, ascending from 0, and their penalties."""
    ids = np.frombuffer(b"".join(s.ids for s in stretches), "<u4")
    ends = np.cumsum([len(s.ids) // 4 for s in stretches])
    free = np.zeros(len(ids) + 1, bool)
    free[ends] = free[0] = True
    # the end id is a place of its own; the sentence end just before it is no use
    sentence = np.zeros(len(ids) + 1, bool)
    sentence[1:] = sentence_end[ids]
    places = np.flatnonzero(free | sentence)
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > FORCED_GAP)
    if len(wide):
        cut = free | sentence
        for w in wide:
            cut[places[w] + FORCED_STEP : places[w + 1] : FORCED_STEP] = True
        places = np.flatnonzero(cut)
    penalty = np.where(free[places], 0, np.where(sentence[places], SENTENCE_PENALTY, FORCED_PENALTY))
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> tuple[list[float], list[int]]:
    """Least cost of cutting at each place, and the place before it on the best way."""
    n = len(places)
    at, extra = places.tolist(), (penalty + OVERHEAD).tolist()
    exact: list[list[int]] = []
    size = SMALLEST_POWER
    while size <= window:
        i = np.searchsorted(places, places - size)
        exact.append(np.where(places[np.minimum(i, n - 1)] == places - size, i, -1).tolist())
        size *= 2
    has = (np.max(exact, axis=0) >= 0).tolist()
    cost, came = [0.0] * n, [-1] * n
    queue: deque[tuple[float, int]] = deque()
    for j in range(1, n):
        i = j - 1
        g = cost[i] + at[i]
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, i))
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        best, i = queue[0]
        best += window - here
        if has[j]:
            for row in exact:
                k = row[j]
                if k >= 0 and cost[k] < best:
                    best, i = cost[k], k
        cost[j], came[j] = best + extra[j], i
    return cost, came


def _tail(length: int, window: int = WINDOW) -> list[int]:
    """Lengths of the windows of the last ids of a partition: powers of two unless little padding is left."""
    out = []
    while length:
        take = length if length <= window and window - length <= 2 * FORCED_PENALTY else 1 << (min(length, window).bit_length() - 1)
        out.append(take)
        length -= take
    return out


def windows(stretches: list[Stretch], sentence_end: np.ndarray, last: bool, window: int = WINDOW) -> list[int]:
    """Ends of the windows cut from the stream.  Unless ``last``, ids behind the last end wait for more."""
    total = sum(len(s.ids) // 4 for s in stretches)
    if total <= window and not last:
        return []
    ends: list[int] = []
    if total > window:
        places, penalty = cut_places(stretches, sentence_end)
        cost, came = best_cuts(places, penalty, window)
        first = int(np.searchsorted(places, total - window, side="right"))
        j = min(range(first, len(places)), key=lambda k: cost[k] + (total - int(places[k]) if last else 0))
        while j > 0:
            ends.append(int(places[j]))
            j = came[j]
        ends.reverse()
    if last:
        at = ends[-1] if ends else 0
        for length in _tail(total - at, window):
            at += length
            ends.append(at)
    return ends


def pieces(stretches: list[Stretch], ends: list[int], first_sequence: int) -> tuple[list[tuple], list[Stretch]]:
    """(doc, start, length, crc, total, sequence, offset) of everything up to the last end, and what is left."""
    rows, rest = [], []
    w, begun, at = 0, 0, 0
    for s in stretches:
        done, size = 0, len(s.ids) // 4
        while done < size and w < len(ends):
            take = min(size - done, ends[w] - at)
            part = s.ids[4 * done : 4 * (done + take)]
            rows.append((s.doc, s.start + done, take, zlib.crc32(part), s.total, first_sequence + w, at - begun))
            done, at = done + take, at + take
            if at == ends[w]:
                w, begun = w + 1, at
        if done < size:
            rest.append(Stretch(s.doc, s.start + done, s.total, s.ids[4 * done :]))
    return rows, rest


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of ``SCHEMA``.  ``tokenizer`` is the path of a tokenizer file that every executor has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer or default_tokenizer())
        end = np.array([END_ID], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        held: list[Stretch] = []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, sequence
            ends = windows(held, encoder.sentence_end, last, window)
            rows, held = pieces(held, ends, sequence)
            sequence += len(ends)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy().tolist()
            for a, b in slices(sizes, SLICE):
                for doc, tokens in zip(ids[a:b], encoder.encode(texts.slice(a, b - a)), strict=True):
                    held.append(Stretch(doc, 0, len(tokens) // 4 + 1, tokens + end))
                yield flush(False)
        yield flush(True)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SCHEMA)
