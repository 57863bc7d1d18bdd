"""A slot for scorers of (query, text) pairs, such as cross-encoders.

The scorer is a callable from a list of pairs to a list of numbers.  It runs inside Arrow tasks with bounded
batches; rows keep all their columns and gain ``cross_score`` and ``cross_error``.  A batch that fails is halved until the
pairs that fail are alone: these keep a reason and no score, the others keep their scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import top_k

Scorer = Callable[[list[tuple[str, str]]], list[float]]
Scored = tuple[list[float | None], list[str | None]]


def _batches(pairs: list[tuple[str, str]], most_pairs: int, most_chars: int) -> Iterator[list[tuple[str, str]]]:
    held: list[tuple[str, str]] = []
    size = 0
    for pair in pairs:
        chars = len(pair[0]) + len(pair[1])
        if held and (len(held) == most_pairs or size + chars > most_chars):
            yield held
            held, size = [], 0
        held.append(pair)
        size += chars
    if held:
        yield held


def _run(scorer: Scorer, pairs: list[tuple[str, str]]) -> Scored:
    try:
        found = [float(x) for x in scorer(pairs)]
        if len(found) != len(pairs):
            raise ValueError(f"{len(found)} scores for {len(pairs)} pairs")
    except Exception as problem:  # noqa: BLE001 - whatever a model raises is kept as the reason
        if len(pairs) == 1:
            return [None], [f"{type(problem).__name__}: {problem}"]
        half = len(pairs) // 2
        left, right = _run(scorer, pairs[:half]), _run(scorer, pairs[half:])
        return left[0] + right[0], left[1] + right[1]
    good = [math.isfinite(x) for x in found]
    return [x if g else None for x, g in zip(found, good, strict=True)], [None if g else "not a finite number" for g in good]


def score_pairs(pairs: DataFrame, scorer: Scorer, query: str, text: str, most_pairs: int = 64, most_chars: int = 400_000) -> DataFrame:
    """``pairs`` with ``cross_score`` and ``cross_error``.  Null texts count as empty; a pair longer than ``most_chars`` is a batch of its own."""
    at = [pairs.columns.index(query), pairs.columns.index(text)]
    schema = T.StructType([*pairs.schema.fields, T.StructField("cross_score", T.DoubleType()), T.StructField("cross_error", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [(a or "", b or "") for a, b in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            scores: list[float | None] = []
            errors: list[str | None] = []
            for some in _batches(asked, most_pairs, most_chars):
                own = _run(scorer, some)
                scores += own[0]
                errors += own[1]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cross_score", "cross_error"])

    return pairs.mapInArrow(work, schema)


def cross_rerank(pairs: DataFrame, scorer: Scorer, keys: list[str], query: str, text: str, order: str, k: int = 4, **bounds) -> DataFrame:
    """The ``k`` best pairs of each query by score, as ``place``; ties and pairs without a score keep the order that they came in (``order``), the
    latter after all others."""
    scored = score_pairs(pairs, scorer, query, text, **bounds)
    return top_k(scored, keys, [F.col("cross_score").desc_nulls_last(), F.col(order)], k, "place")
