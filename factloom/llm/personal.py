"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The network reads characters (their classes and ASCII values), both ways, and
gives every position a score for each tag (outside, and first and inner
character of each kind); the CRF adds scores for tag pairs, and the best tag path of
a window is decoded.  It is trained in numpy, by the likelihood of the true
path, on windows around labelled spans: what the patterns find in all rows, of each
kind the ``MOST_SPANS`` places of the least hash, and the same spans written in ways the
patterns do not know (other separators, spaced or bracketed marks).  Windows
without spans come from about ``SAMPLE_DOCS`` rows chosen by hash.

Texts are read in windows of ``WINDOW`` characters that overlap by half, placed
wherever a text has an ASCII digit or an at sign, as every labelled span has.
Personal data spelled out in words (name at host dot org) is neither trained nor read.  Where
windows overlap, each position takes the tags of the window whose middle is
nearer, then spans are read off the whole text.  Found spans that touch none of
the patterns' spans are added to them.

Only the number of examples is bounded; labels and the scan cover all rows and whole texts.

Edge cases: null counts as empty and gives no spans; a text shorter than a
window is padded; repeated rows give equal results; an empty table gives no
rows; with fewer than ``MIN_SPANS`` labelled spans only patterns are reported;
other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import Least, marked_texts
from .spans import Span, digest, joined, uncovered
from ..session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LEARNED = tuple(f"like_{k}" for k in KINDS)
SAMPLE_DOCS = 4000
MOST_SPANS = 240
MIN_SPANS = 20
WINDOW = 64
STRIDE = 32
HIDDEN = 16
ROUNDS = 10
BATCH = 32
RATE = 0.02
SLICE_WINDOWS = 2048
LEAST_CHARS = {"email": 6, "ip": 7, "card": 12, "phone": 9}

# Patterns of the contract (fixed values), in forms that take time in proportion to the text: what a run of digits is followed by does not
# depend on where in the run a match starts, so a run is tried once, from its left end, and never given back.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and non-overlapping in each kind; failing matches are dropped."""
    out: list[Span] = []
    out += [("email", start, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of name, at sign and host, from left to right: each at sign with the run of name characters before it that no match holds."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            taken = host.end()
            yield start, taken
        at = text.find("@", max(at + 1, taken))


def _small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


# ---- characters and tags

_CHARS = 24


def codes(text: str) -> np.ndarray:
    """Class of every character: letters by case, digits, marks one by one, space, others."""
    table = _table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return table[np.minimum(points, 128)]


def _table() -> np.ndarray:
    table = np.full(129, 2, np.int8)
    table[65:91], table[97:123], table[48:58], table[128] = 4, 5, 6, 3
    table[[32, 9, 10, 13]] = 1
    for i, c in enumerate("@.+-()_%:/,;[]{}"):
        table[ord(c)] = 7 + i
    return table


TAGS = 1 + 2 * len(KINDS)


def tags(length: int, spans: list[Span], start: int) -> np.ndarray:
    """Tags of the window of ``length`` from ``start``: 0 outside, then first and inner character of each kind."""
    out = np.zeros(length, np.int64)
    for kind, s, e in spans:
        k = 1 + 2 * KINDS.index(kind)
        a, b = max(s - start, 0), min(e - start, length)
        if a < b:
            out[a:b] = k + 1
            if s >= start:
                out[a] = k
    return out


def spans_of(path: np.ndarray) -> list[Span]:
    """Maximal runs of one kind, cut where another first character comes."""
    kind = np.where(path > 0, (path + 1) // 2, 0)
    first = (path > 0) & (path % 2 == 1)
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0) | np.append(first, False))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if kind[a]:
            out.append((f"like_{KINDS[kind[a] - 1]}", int(a), int(b)))
    return out


# ---- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network(NamedTuple):
    """Input tables (class to gates), recurrent weights and start states of both directions, tag scores, tag pairs."""

    inputs: np.ndarray  # 2, classes, 4 * hidden
    recur: np.ndarray  # 2, hidden, 4 * hidden
    out: np.ndarray  # 2 * hidden, tags
    bias: np.ndarray  # tags
    pairs: np.ndarray  # tags, tags


def new_network(seed: int) -> Network:
    draw = np.random.default_rng(seed)
    shape = lambda *n, s=0.2: draw.normal(0, s, n).astype(np.float32)
    inputs = shape(2, _CHARS, 4 * HIDDEN, s=0.5)
    inputs[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # remember at first
    return Network(inputs, shape(2, HIDDEN, 4 * HIDDEN), shape(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))


def _read(net: Network, x: np.ndarray, way: int, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) of one direction; with ``keep``, also what training needs."""
    steps, n = x.shape[1], len(x)
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    kept = []
    table, recur = net.inputs[way], net.recur[way]
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        z = table[x[:, t]] + h @ recur
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((t, h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out, kept


def emissions(net: Network, x: np.ndarray, keep: bool = False):
    """Tag scores (time, batch, tags) of windows ``x`` (batch, time)."""
    ways = [_read(net, x, w, keep) for w in (0, 1)]
    hidden = np.concatenate([ways[0][0], ways[1][0]], axis=2)
    return hidden @ net.out + net.bias, hidden, [w[1] for w in ways]


def best_paths(scores: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best tag path of every window (batch, time)."""
    steps, n, k = scores.shape
    best = scores[0]
    back = np.empty((steps, n, k), np.int8)
    for t in range(1, steps):
        options = best[:, :, None] + pairs[None]
        back[t] = options.argmax(1)
        best = options.max(1) + scores[t]
    path = np.empty((n, steps), np.int64)
    path[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t][rows, path[:, t]]
    return path


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _crf(scores: np.ndarray, pairs: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the true paths, and its slopes by scores and pairs."""
    steps, n, k = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + pairs[None], 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        behind[t] = _log_sum(pairs[None] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    norm = _log_sum(ahead[-1], 1)
    d_scores = np.exp(ahead + behind - norm[None, :, None])
    d_pairs = np.zeros_like(pairs)
    loss = norm.sum()
    rows = np.arange(n)
    for t in range(steps):
        d_scores[t][rows, y[:, t]] -= 1
        loss -= scores[t][rows, y[:, t]].sum()
        if t:
            both = ahead[t - 1][:, :, None] + pairs[None] + (scores[t] + behind[t])[:, None, :] - norm[:, None, None]
            d_pairs += np.exp(both).sum(0)
            np.add.at(d_pairs, (y[:, t - 1], y[:, t]), -1)
            loss -= pairs[y[:, t - 1], y[:, t]].sum()
    return float(loss / n), d_scores / n, d_pairs / n


def _slopes(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, Network]:
    """Loss and its slopes by every parameter: backward through the CRF, then through time in both directions."""
    scores, hidden, kept = emissions(net, x, keep=True)
    loss, d_scores, d_pairs = _crf(scores, net.pairs, y)
    d_out = np.einsum("tnh,tnk->hk", hidden, d_scores)
    d_hidden = d_scores @ net.out.T
    d_inputs, d_recur = np.zeros_like(net.inputs), np.zeros_like(net.recur)
    for way in (0, 1):
        dh = np.zeros((len(x), HIDDEN), np.float32)
        dc = np.zeros((len(x), HIDDEN), np.float32)
        for t, h, before, i, f, o, g, tc in reversed(kept[way]):
            dh = dh + d_hidden[t][:, way * HIDDEN : (way + 1) * HIDDEN]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            np.add.at(d_inputs[way], x[:, t], dz)
            d_recur[way] += h.T @ dz
            dh = dz @ net.recur[way].T
            dc = dc * f
    return loss, Network(d_inputs, d_recur, d_out, d_scores.sum((0, 1)), d_pairs)


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Network:
    """Adam with clipped slopes over shuffled batches of windows."""
    net = new_network(seed)
    draw = np.random.default_rng(seed)
    means, squares = ([np.zeros_like(p) for p in net] for _ in range(2))
    step = 0
    for r in range(rounds):
        rate = RATE * (0.5 if r >= rounds * 2 // 3 else 1.0)
        order = draw.permutation(len(x))
        for a in range(0, len(x), BATCH):
            own = order[a : a + BATCH]
            _, slope = _slopes(net, x[own], y[own])
            size = np.sqrt(sum(float((s * s).sum()) for s in slope))
            step += 1
            for p, s, m, q in zip(net, slope, means, squares, strict=True):
                s = s * min(1.0, 5.0 / max(size, 1e-9))
                m += 0.1 * (s - m)
                q += 0.001 * (s * s - q)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# ---- windows of texts


def window_starts(text: str) -> list[int]:
    """Starts of the windows of a text: on a grid of ``STRIDE``, so that every cue lies in two of them, one by its middle."""
    wanted: set[int] = set()
    for m in _CUE.finditer(text):
        cell = m.start() // STRIDE
        wanted.update((cell - 2, cell - 1, cell, cell + 1))
    return [c * STRIDE for c in sorted(wanted) if -STRIDE <= c * STRIDE < len(text)]


def _windows(text: str, starts: list[int]) -> np.ndarray:
    c = codes(text)
    padded = np.concatenate([np.zeros(WINDOW, np.int8), c, np.zeros(2 * WINDOW, np.int8)])
    return padded[np.array(starts)[:, None] + WINDOW + np.arange(WINDOW)[None]]


def learned_spans(texts: list[str], net: Network) -> list[list[Span]]:
    """Spans that the network reads off each text; texts are handled together, ``SLICE_WINDOWS`` windows at a time."""
    starts = [window_starts(t) for t in texts]
    paths: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            x = np.concatenate([w for _, w in held])
            decoded = best_paths(emissions(net, x)[0], net.pairs)
            at = 0
            for i, w in held:
                paths[i].append(decoded[at : at + len(w)])
                at += len(w)
            held.clear()

    waiting = 0
    for i, s in enumerate(starts):
        for a in range(0, len(s), SLICE_WINDOWS):
            part = s[a : a + SLICE_WINDOWS]
            held.append((i, _windows(texts[i], part)))
            waiting += len(part)
            if waiting >= SLICE_WINDOWS:
                flush()
                waiting = 0
    flush()
    out = []
    quarter = (WINDOW - STRIDE) // 2
    for t, s, p in zip(texts, starts, paths, strict=True):
        if not s:
            out.append([])
            continue
        path = np.zeros(len(t) + 3 * WINDOW, np.int8)
        for start, row in zip(s, np.concatenate(p), strict=True):
            # the middle half of a window; the grid's middles meet without overlap
            a = start + quarter + WINDOW
            path[a : a + STRIDE] = row[quarter : quarter + STRIDE]
        found = spans_of(path[WINDOW : WINDOW + len(t)])
        out.append([(k, a, b) for k, a, b in found if b - a >= LEAST_CHARS[k[5:]] and _CUE.search(t, a, b)])
    return out


# ---- fit and scan


def disguises(kind: str, found: str) -> list[str]:
    """Other ways to write a span, which the patterns miss."""
    if kind == "email":
        name, host = found.split("@", 1)
        return [f"{name} @ {host}", f"{name}@{host.replace('.', ' . ')}", f"{name}(@){host}"]
    if kind == "ip":
        return [found.replace(".", " . "), found.replace(".", "-")]
    if kind == "card":
        digits = re.sub(r"\D", "", found)
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "  ".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return [found.replace(" ", "/").replace("-", "/"), "00" + found[1:]]


def _labelled(most: int):
    """(kind, rank, text around a span, its place there) of a task: spans of all texts; of sampled texts without spans, kind ``cue`` or ``none``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = Least(most)
        for batch in batches:
            for text, sampled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(base_spans(text), key=lambda x: x[1])
                starts = [x for _, x, _ in found]
                for kind, s, e in found:
                    a, b = max(0, s - WINDOW), e + WINDOW
                    near = found[bisect_left(starts, a) : bisect_left(starts, b)]
                    least.add(kind, (text[a:b], ",".join(f"{k}:{x - a}:{y - a}" for k, x, y in near if y <= b), s - a, e - a))
                if sampled and not found:
                    m = _CUE.search(text)
                    a = max(0, (m.start() if m else len(text) // 2) - WINDOW)
                    least.add("cue" if m else "none", (text[a : a + 2 * WINDOW], "", 0, 0))
        columns = list(zip(*least, strict=True)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "rank", "around", "marks", "s", "e"])

    return work


def examples(rows: list[tuple[str, str, str, int, int]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: each labelled place at several offsets, as written and disguised."""
    draw = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans: list[Span], centre: int) -> None:
        start = centre - int(draw.integers(8, WINDOW - 8))
        xs.append(_windows(text, [max(start, -WINDOW)])[0])
        ys.append(tags(WINDOW, spans, max(start, -WINDOW)))

    for kind, around, marks, s, e in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (m.split(":") for m in marks.split(",") if m)]
        if kind not in KINDS:
            add(around, [], len(around) // 2)
            continue
        for _ in range(2):
            add(around, spans, (s + e) // 2)
        options = disguises(kind, around[s:e])
        other = options[int(draw.integers(len(options)))]
        shift = len(other) - (e - s)
        moved = [(k, a + shift * (a >= e), b + shift * (a >= e)) for k, a, b in spans if b <= s or a >= e]
        add(around[:s] + other + around[e:], [*moved, (kind, s, s + len(other))], s + len(other) // 2)
    return np.array(xs), np.array(ys)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = MOST_SPANS, key: str = "doc_id", text: str = "text") -> Network | None:
    """Network trained on at most ``most`` places of each kind, chosen by hash among all rows, and windows without spans of about ``sample_docs`` rows."""
    schema = "kind string, rank long, around string, marks string, s int, e int"
    found = cut_lineage(marked_texts(docs, sample_docs, key, text).mapInArrow(_labelled(most), schema)).distinct()
    rows: list[tuple] = []
    for kind in (*KINDS, "cue", "none"):
        own = found.where(F.col("kind") == kind).orderBy("rank", "around", "s", "marks").limit(most).drop("rank").collect()
        rows += [tuple(r) for r in own]
    if sum(r[0] in KINDS for r in rows) < MIN_SPANS:
        return None
    return train(*examples(rows))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_learned long"


def all_spans(texts: list[str | None], net: Network | None) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, spans that the network adds) of each text."""
    whole = [t or "" for t in texts]
    extra = learned_spans(whole, net) if net else [[] for _ in whole]
    out = []
    for t, more in zip(whole, extra, strict=True):
        base = base_spans(t)
        out.append((base, uncovered(more, base)))
    return out


def scan(docs: DataFrame, net: Network | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every text (columns of ``RESULT``).  The network is trained on the table unless given."""
    net = net or fit(docs, key=key, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, extra in all_spans(batch.column(1).to_pylist(), net):
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in KINDS), digest(joined(base, KINDS)), joined(base + extra, (*KINDS, *LEARNED)), len(extra)))
            names = [c.split()[0] for c in RESULT.split(", ")]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, RESULT)


def masked(docs: DataFrame, net: Network | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, with every span of the text replaced by its kind in angle brackets (a null text stays null)."""
    net = net or fit(docs, key=key, text=text)
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            clean = [None if t is None else mask(t, base + extra) for t, (base, extra) in zip(texts, all_spans(texts, net), strict=True)]
            columns = [pa.array(clean, batch.schema.field(place).type) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with every span, or union of overlapping spans, replaced by its (first) kind in angle brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.removeprefix('like_')}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
