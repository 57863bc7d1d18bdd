"""Words and word shingles of whole texts as 64-bit hashes, computed with numpy over batches of texts.

A word is a maximal run of bytes other than space and U+0009..U+000D (the same
as ``[^\\x20\\x09-\\x0D]+`` on characters, since those bytes never occur inside
a longer UTF-8 sequence).  Memory is bounded by blocks of ``BLOCK`` bytes, which
are cut at white space, plus eight bytes per word of the texts in hand.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_STEPS = np.array([0xD6E8FEB86659FD93 ^ (k * 0xA0761D6478BD642F) & (2**64 - 1) | 1 for k in range(16)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _block_words(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of one block that ends in white space."""
    b = np.frombuffer(raw, np.uint8)
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
    start, end = edge[::2], edge[1::2]
    size = max(1 << 19, 1 << int(len(raw)).bit_length())
    up, down = _powers(size)
    value = (_LOWER[b] if lower else b).astype(np.uint64) + np.uint64(1)
    value *= up[: len(b)]
    total = np.cumsum(value)
    before = np.where(start > 0, total[start - 1], np.uint64(0)) if len(start) else np.zeros(0, np.uint64)
    return mix((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    """(text number, part of the text), long texts cut at white space."""
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while len(raw) - at > BLOCK and (m := _GAP.search(raw, at + BLOCK)):
            yield i, raw[at : m.end()]
            at = m.end()
        yield i, raw[at:]


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets of the texts in them (null: no words)."""
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            words, start = _block_words(b"\n".join([r for _, r in held]) + b"\n", lower)
            offsets = np.cumsum([0] + [len(r) + 1 for _, r in held])
            cut = np.searchsorted(start, offsets)
            np.add.at(counts, [i for i, _ in held], np.diff(cut))
            found.append(words)
            held, size = [], 0

    for i, raw in _pieces(texts):
        held.append((i, raw))
        size += len(raw)
        if size >= BLOCK:
            flush()
    flush()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words of each text; a text of 1..k-1 words gives its whole sequence
    as one, a text without words none.  Returns hashes in text order and their n + 1 offsets."""
    counts = np.diff(offsets)
    full = np.maximum(counts - k + 1, 0)
    out_counts = np.where((counts > 0) & (counts < k), 1, full)
    out = np.concatenate([[0], np.cumsum(out_counts)])
    first = np.repeat(offsets[:-1] - out[:-1], out_counts) + np.arange(out[-1])
    length = np.repeat(np.minimum(counts, k), out_counts)
    total = length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        total += np.where(j < length, padded[first + j] * _STEPS[j], np.uint64(0))
    return mix(total), out


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about ``most``; each holds one item at least."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: list[str | None], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so that work arrays stay small whatever the batch holds."""
    return slices([len(t or "") for t in texts], most)
