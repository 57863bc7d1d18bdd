"""Toxicity: a factorization machine over hashed terms.

A text's score is a bias, a weight for each of its terms, and for each pair of
its terms the product of their factor vectors: so an insult together with the
mention of a group counts for more than both alone, which additive weights cannot
say.  Terms are the distinct lower-case words without marks at their ends, and
the first four and five letters of longer ones (compounds and inflections), weighted by the inverse of their frequency in the
training rows and by the evidence that they tell the classes apart.  No term is cut off by a count: evidence is a
chi-square of one term, so a term of one class has a say from its second row on, and one that falls on both
classes alike fades at any frequency.  Pairs cost no more than terms, because

    sum over pairs of v_a . v_b  =  (|sum v|^2 - sum |v|^2) / 2.

The fit uses at most ``MOST_ROWS`` labelled rows in one process, in numpy, by
adaptive gradient steps on the logistic loss; scoring runs inside the tasks.

Edge cases: null counts as empty; an empty text gets the score of the bias;
repeated rows get equal scores; an empty table gives no rows; without labels of
both classes every score is the share of label 1 (0.5 without labels at all);
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import logistic, platt, score_texts
from .samples import remainder, training_rows
from .words import mix, text_slices, word_hashes

MOST_ROWS = 6000
TERM_BITS = 18
FACTORS = 4
ROUNDS = 12
BATCH = 64
HEADS = (4, 5)
RATE = 0.2
PAIR_RATE = 0.08
DECAY = 0.05
DOUBT = 10.0
SCALE = 0.3
ACCEPT = 0.5
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term numbers of all texts in text order, and their n + 1 offsets."""
    bare = [_MARKS.sub(b" ", (t or "").encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass") for t in texts]
    keys = []
    heads = [[" ".join({w[:n] for w in t.lower().split() if len(w) > n}) for t in bare] for n in HEADS]
    for salt, forms in enumerate((bare, *heads)):
        words, offsets = word_hashes(forms)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        keys.append((doc << TERM_BITS) | (mix(words + np.uint64(salt)) >> np.uint64(64 - TERM_BITS)).astype(np.int64))
    found = np.unique(np.concatenate(keys))
    return (found & ((1 << TERM_BITS) - 1)).astype(np.int32), np.searchsorted(found, np.arange(len(texts) + 1) << TERM_BITS)


class Machine(NamedTuple):
    """Bias, weights, factors, the weight of each term's presence, and the logistic curve to probabilities."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    presence: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = np.diff(offsets)
        out = np.full(len(n), self.bias)
        full = n > 0
        if not full.any():
            return out
        at = offsets[:-1][full]
        x = self.presence[ids]
        v = self.factors[ids] * x[:, None]
        pairs = ((np.add.reduceat(v, at) ** 2).sum(1) - np.add.reduceat((v * v).sum(1), at)) / 2
        out[full] += np.add.reduceat(self.weights[ids] * x, at) + pairs
        return out

    def probabilities(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return logistic(self.slope * self.margins(ids, offsets) + self.shift)


def evidence(counts: np.ndarray, ones: np.ndarray, share: float) -> np.ndarray:
    """Trust in terms of ``counts`` rows, ``ones`` of them of label 1, where ``share`` of all rows is: 0 to 1, a half at a chi-square of ``DOUBT``."""
    off = np.maximum(np.abs(ones - counts * share) - 0.5, 0)
    chi = off**2 / np.maximum(counts * share * (1 - share), 1e-9)
    return chi / (chi + DOUBT)


def train(rows: list[np.ndarray], labels: np.ndarray, share_of_ones: float, rounds: int = ROUNDS, seed: int = 3) -> Machine:
    """Fit on four fifths, and the curve to probabilities on the rest."""
    n = 1 << TERM_BITS
    draw = np.random.default_rng(seed)
    bias, weights = 0.0, np.zeros(n)
    factors = draw.normal(0, 0.01, (n, FACTORS))
    if len(set(labels.tolist())) < 2:
        p = min(max(share_of_ones, 0.01), 0.99)
        return Machine(float(np.log(p / (1 - p))), weights, 0 * factors, np.zeros(n))
    aside = np.arange(len(rows)) % 5 == 0
    if len(set(labels[aside].tolist())) < 2 or len(set(labels[~aside].tolist())) < 2:
        aside = np.zeros(len(rows), bool)
    fitted = np.flatnonzero(~aside)
    counts, ones = np.zeros(n), np.zeros(n)
    for i in fitted:
        counts[rows[i]] += 1
        ones[rows[i]] += labels[i]
    share = float(labels[fitted].mean())
    rarity = SCALE * np.log((len(fitted) + 2) / np.maximum(counts, 1))
    presence = rarity * evidence(counts, ones, share)
    # a fitted row does not vouch for its own terms, or those of one row would say nothing but which row that is
    others = np.stack([rarity * evidence(np.maximum(counts - 1, 0), np.maximum(ones - y, 0), share) for y in (0, 1)])
    past_b, past_w, past_v = 1e-8, np.full(n, 1e-8), np.full((n, FACTORS), 1e-8)
    for _ in range(rounds):
        order = draw.permutation(fitted)
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            ids = np.concatenate([rows[i] for i in own])
            lengths = np.array([len(rows[i]) for i in own])
            if not len(ids):
                continue
            doc = np.repeat(np.arange(len(own)), lengths)
            x = others[labels[own][doc], ids]
            v = factors[ids] * x[:, None]
            total = np.stack([np.bincount(doc, v[:, f], len(own)) for f in range(FACTORS)], axis=1)
            pairs = ((total**2).sum(1) - np.bincount(doc, (v * v).sum(1), len(own))) / 2
            margin = bias + np.bincount(doc, weights[ids] * x, len(own)) + pairs
            error = logistic(margin) - labels[own]
            terms_, place = np.unique(ids, return_inverse=True)
            pull = (error[doc] * x)[:, None]
            slope_v = pull * (total[doc] - v)
            grad_w = np.bincount(place, pull[:, 0]) + DECAY * weights[terms_]
            grad_v = np.stack([np.bincount(place, slope_v[:, f]) for f in range(FACTORS)], axis=1) + DECAY * factors[terms_]
            past_w[terms_] += grad_w**2
            past_v[terms_] += grad_v**2
            past_b += error.sum() ** 2
            weights[terms_] -= RATE * grad_w / np.sqrt(past_w[terms_])
            factors[terms_] -= PAIR_RATE * grad_v / np.sqrt(past_v[terms_])
            bias -= RATE * error.sum() / np.sqrt(past_b)
    model = Machine(float(bias), weights, factors, presence)
    seen = np.flatnonzero(aside) if aside.any() else fitted
    ids = np.concatenate([rows[i] for i in seen])
    margins = model.margins(ids, np.concatenate([[0], np.cumsum([len(rows[i]) for i in seen])]))
    y = labels[seen]
    weight = np.where(y == 1, share_of_ones / max(1, y.sum()), (1 - share_of_ones) / max(1, (1 - y).sum())) * len(y)
    slope, shift = platt(margins, y, weight, guarded=True)
    return model._replace(slope=slope, shift=shift, weights=weights.astype(np.float32), factors=factors.astype(np.float32), presence=presence.astype(np.float32))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in text_slices(texts, 2 << 20):
            ids, at = terms(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([ids[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                names=["doc_id", "label", "ids"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_fold: int = 0, most: int = MOST_ROWS,
        key: str = "doc_id", text: str = "text") -> Machine:
    """Learn from labelled rows whose crc32(key) mod ``folds`` is not ``held_fold``."""
    held = remainder(key, folds) == held_fold
    rows = training_rows(docs, labels, label, held, most, key, text)
    found = rows.mapInArrow(_term_rows, "doc_id long, label int, ids binary").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    ids = [np.frombuffer(x, np.int32) for x in found.column("ids").to_pylist()]
    ones = labels.where(~held).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(ids, np.array(found.column("label").to_pylist(), np.int64), 0.5 if ones is None else ones)


def toxicity(docs: DataFrame, labels: DataFrame, model: Machine | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every row; the model is learned from ``labels`` unless given."""
    model = model or fit(docs, labels, key=key, text=text)
    return score_texts(lambda texts: model.probabilities(*terms(texts)), docs, 5, 0, ACCEPT, key, text)
