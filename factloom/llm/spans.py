"""Spans of kinds in texts: joined strings, digests and merging.  A span is (kind, start, end), end exclusive, in code points."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(found: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], rank.get(x[0], len(rank)), x[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def uncovered(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that touch no span of ``base``."""
    base = sorted(base, key=lambda x: x[1])
    out, i, reach = [], 0, -1
    for span in sorted(spans, key=lambda x: x[1]):
        while i < len(base) and base[i][1] < span[2]:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= span[1]:
            out.append(span)
    return out
