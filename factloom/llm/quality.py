"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words and word pairs, and runs of up
to four word shapes (case, marks at the ends, length, equal to a word just
before) with the share of the text that they make up, in steps of two.  Each
indicator is scaled by its log-count ratio between the classes, and a linear
hinge-loss model is fitted to them by dual coordinate descent.  Margins become
probabilities by a logistic curve fitted to rows that the model did not see.

The fit uses at most ``MOST_ROWS`` labelled rows (``samples.training_rows``), in
one process, in numpy; scoring runs in batches inside the tasks over all rows.

Edge cases: null counts as empty; an empty text has no n-grams and gets the
score of the bias alone; repeated rows get equal scores; an empty table gives no
rows; without labels of both classes every score is the share of label 1 (0.5
without labels at all); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import remainder, training_rows
from .words import _pieces, _SPACE, _STEPS, mix, text_slices, word_hashes

MOST_ROWS = 6000
FEATURE_BITS = 20
ROUNDS = 12
PENALTY = 0.05
SHAPE_RUN = 4
ACCEPT = 0.7


def word_shapes(texts: list[str | None]) -> np.ndarray:
    """Shape of every word: case, first and last byte's class, and length, as one small number."""
    out = []
    for _, raw in _pieces(texts):
        b = np.frombuffer(raw + b"\n", np.uint8)
        gap = _SPACE[b]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
        start, end = edge[::2], edge[1::2]
        upper = np.concatenate([[0], np.cumsum((b >= 65) & (b <= 90))])
        digit = np.concatenate([[0], np.cumsum((b >= 48) & (b <= 57))])
        mark = np.concatenate([[0], np.cumsum((b < 128) & ~(((b | 32) >= 97) & ((b | 32) <= 122)) & ~((b >= 48) & (b <= 57)))])
        n = end - start
        ups, digits, marks = (x[end] - x[start] for x in (upper, digit, mark))
        case = np.select([ups == 0, ups >= np.maximum(2, n // 2), b[start] < 97], [0, 1, 2], 3)
        kind = (marks > 0).astype(np.int64) + (marks > 1) + (marks == n)
        last = np.where(marks > 0, b[end - 1], 0).astype(np.int64)
        out.append(((case * 4 + kind) * 3 + np.minimum(digits, 2)) * 4 + np.minimum(n // 4, 3) + (last << 10))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _runs(symbols: np.ndarray, offsets: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` symbols inside a text, and its text's number."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += symbols[j : j + n] * _STEPS[j]
    inside = doc[:n] == doc[k - 1 : k - 1 + n]
    return mix(total[inside]), doc[:n][inside]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all texts in text order, and their n + 1 offsets."""
    words, offsets = word_hashes(texts, lower=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    shapes = word_shapes(texts)
    same = np.zeros(len(words), np.int64)
    for back in (2, 1):
        same[back:][(words[back:] == words[:-back]) & (doc[back:] == doc[:-back])] = back
    shape = mix((shapes + (same << 20)).astype(np.uint64))
    keys = []
    for k in (1, 2):
        h, d = _runs(words, offsets, doc, k)
        keys.append((d << FEATURE_BITS) | (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    lengths = np.maximum(np.diff(offsets), 1)
    for k in range(1, SHAPE_RUN + 1):
        h, d = _runs(shape, offsets, doc, k)
        runs, n = np.unique((d << 44) | (h >> np.uint64(20)).astype(np.int64), return_counts=True)
        d = runs >> 44
        share = np.floor(np.log2(n / lengths[d])).astype(np.int64)
        h = mix((runs & ((1 << 44) - 1)).astype(np.uint64) + (share & 31).astype(np.uint64) * _STEPS[k])
        keys.append((d << FEATURE_BITS) | (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    at = np.searchsorted(found, np.arange(len(texts) + 1) << FEATURE_BITS)
    return (found & ((1 << FEATURE_BITS) - 1)).astype(np.int32), at


class Classifier(NamedTuple):
    """Weight of every feature, bias, and the logistic curve from margin to probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probabilities(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        n = np.diff(offsets)
        margins = self.bias + np.where(n > 0, (total[offsets[1:]] - total[offsets[:-1]]) / np.sqrt(np.maximum(n, 1)), 0.0)
        return logistic(self.slope * margins + self.shift)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, n_features: int, smooth: float = 1.0) -> np.ndarray:
    """Per feature, the log of its share of class 1's indicators over that of class 0's."""
    sums = [np.full(n_features, smooth), np.full(n_features, smooth)]
    for ids, y in zip(rows, labels, strict=True):
        sums[y][ids] += 1
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, rounds: int, penalty: float, seed: int) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model of rows of scaled indicators (each row of length 1 by its count), by dual coordinate descent.

    Maximises the dual one example at a time: the example's multiplier moves by
    its margin's error over its squared length, clipped to [0, penalty * its
    class's weight], and the weights follow.  Both classes weigh the same.
    """
    weights, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[ids] / np.sqrt(max(1, len(ids))) for ids in rows]
    squares = [float(v @ v) + 1.0 for v in values]
    share = {s: max(1, int((signs == s).sum())) for s in (-1, 1)}
    limit = np.array([penalty * len(rows) / (2 * share[int(s)]) for s in signs])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            s, v, ids = signs[i], values[i], rows[i]
            step = (1 - s * (float(weights[ids] @ v) + bias)) / squares[i]
            new = min(max(alpha[i] + step, 0.0), limit[i])
            if change := (new - alpha[i]) * s:
                weights[ids] += change * v
                bias += change
                alpha[i] = new
    return weights, bias


def platt(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray, guarded: bool = False) -> tuple[float, float]:
    """Slope and shift of the logistic curve through weighted labels, by Newton's method with smoothed targets.
    ``guarded`` halves steps that raise the loss: few labels with large margins throw full steps off."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * b @ b)

    for _ in range(50):
        p = logistic(x @ beta)
        grad = x.T @ (weight * (p - target)) + 1e-3 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while guarded and np.abs(step).max() >= 1e-8 and loss(beta - step) > loss(beta):
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(rows: list[np.ndarray], labels: np.ndarray, share_of_ones: float, rounds: int = ROUNDS, penalty: float = PENALTY, seed: int = 5) -> Classifier:
    """Fit on four fifths, fit the curve on the rest, in the proportion of the classes that ``share_of_ones`` gives."""
    n_features = 1 << FEATURE_BITS
    if len(set(labels.tolist())) < 2:
        p = min(max(share_of_ones, 0.01), 0.99)
        return Classifier(np.zeros(n_features, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    aside = np.arange(len(rows)) % 5 == 0
    if len(set(labels[aside].tolist())) < 2 or len(set(labels[~aside].tolist())) < 2:
        aside = np.zeros(len(rows), bool)
    fitted = [r for r, a in zip(rows, aside, strict=True) if not a]
    ratio = log_count_ratios(fitted, labels[~aside], n_features)
    weights, bias = dual_descent(fitted, np.where(labels[~aside] == 1, 1, -1), ratio, rounds, penalty, seed)
    model = Classifier((weights * ratio).astype(np.float32), bias, 1.0, 0.0)
    seen = aside if aside.any() else ~aside
    held = [r for r, a in zip(rows, seen, strict=True) if a]
    y = labels[seen]
    margins = np.array([model.bias + float(model.weights[r].sum(dtype=np.float64)) / np.sqrt(max(1, len(r))) for r in held])
    weight = np.where(y == 1, share_of_ones / max(1, y.sum()), (1 - share_of_ones) / max(1, (1 - y).sum())) * len(y)
    return model._replace(**dict(zip(("slope", "shift"), platt(margins, y, weight), strict=True)))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in text_slices(texts, 2 << 20):
            ids, at = features(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([ids[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                names=["doc_id", "label", "ids"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_fold: int = 2, most: int = MOST_ROWS,
        key: str = "doc_id", text: str = "text") -> Classifier:
    """Learn from labelled rows whose crc32(key) mod ``folds`` is not ``held_fold``."""
    held = remainder(key, folds) == held_fold
    rows = training_rows(docs, labels, label, held, most, key, text)
    found = rows.mapInArrow(_feature_rows, "doc_id long, label int, ids binary").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    ids = [np.frombuffer(x, np.int32) for x in found.column("ids").to_pylist()]
    ones = labels.where(~held).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(ids, np.array(found.column("label").to_pylist(), np.int64), 0.5 if ones is None else ones)


def score_texts(score: Callable[[list[str | None]], np.ndarray], docs: DataFrame, folds: int, held_fold: int, accept: float,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ``score`` maps a batch of texts to probabilities."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts, 2 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score(texts[a:b]), pa.float64())],
                    names=["doc_id", "held_out", "score"],
                )

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(remainder(key, folds) == held_fold, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    scored = rows.mapInArrow(work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, model: Classifier | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every row; the model is learned from ``labels`` unless given."""
    model = model or fit(docs, labels, key=key, text=text)
    return score_texts(lambda texts: model.probabilities(*features(texts)), docs, 4, 2, ACCEPT, key, text)


def kept(docs: DataFrame, labels: DataFrame, least: float = ACCEPT, model: Classifier | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``least``."""
    model = model or fit(docs, labels, key=key, text=text)
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            scores = [model.probabilities(*features(texts[a:b])) for a, b in text_slices(texts, 2 << 20)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) >= least))

    return docs.mapInArrow(work, docs.schema)
