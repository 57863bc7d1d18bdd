"""Secret scans: patterns, and formats inferred from labelled credentials.

For each kind of credential a prefix tree of symbol sequences is built from
labelled examples, and states whose outgoing frequencies are statistically
compatible (Hoeffding bound, checked down the tree) are merged into a
probabilistic automaton.  Every other candidate token of every text is scored by
the likelihood of its format against that of ordinary tokens, and reported where
it exceeds a threshold learned from the examples.

Labels are what the patterns find in all rows, of each kind the ``MOST_EXAMPLES`` of the
least hash, so that a kind is learned however few documents have it; ordinary tokens come from about
``SAMPLE_DOCS`` rows chosen by hash.  The scan covers all rows and whole texts.

Edge cases: null counts as empty and gives no spans; repeated rows give equal
results; an empty table gives no rows; with fewer than ``MIN_EXAMPLES``
distinct examples of a kind in the table no automaton of it exists and only patterns are reported; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import Least, marked_texts
from .spans import Span, digest, joined, uncovered
from ..session import cut_lineage

KINDS = ("assign", "access", "hex")
LEARNED = tuple(f"like_{k}" for k in KINDS)
SAMPLE_DOCS = 4000
MOST_EXAMPLES = 400
ALPHA = 0.05
MIN_LENGTH = 16
MIN_EXAMPLES = 20

# Patterns of the contract (fixed values).
_ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and non-overlapping in each kind."""
    out: list[Span] = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def credential(text: str, span: Span) -> str:
    """The secret itself: the value of an assignment, otherwise the whole match."""
    found = text[span[1] : span[2]]
    return _ASSIGN.match(found)[2] if span[0] == "assign" else found


def symbol(c: str) -> str:
    """Symbol of the automata's alphabet: letters of hexadecimal numbers apart from others, marks as they are."""
    if c.isdigit():
        return "0"
    if c.isalpha():
        return ("a" if c in "abcdef" else "z") if c.islower() else ("A" if c in "ABCDEF" else "Z")
    return c


class Automaton(NamedTuple):
    """Probabilistic automaton: transitions and end probability of each state."""

    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]

    def score(self, token: str) -> float:
        """Log likelihood per symbol; symbols that a state never saw get a small probability."""
        state, total = 0, 0.0
        for c in token:
            step = self.moves[state].get(symbol(c)) if state >= 0 else None
            state, p = step if step else (-1, 1e-3)
            total += math.log(p)
        total += math.log(max(self.ends[state], 1e-3) if state >= 0 else 1e-3)
        return total / (len(token) + 1)


class _Tree:
    """Prefix tree with counts; states are merged in place."""

    def __init__(self, examples: list[str]):
        self.seen, self.ended, self.next = [0], [0], [{}]
        for e in examples:
            at = 0
            self.seen[0] += 1
            for c in map(symbol, e):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ended.append(0)
                    self.next.append({})
                at = self.next[at][c]
                self.seen[at] += 1
            self.ended[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (n1**-0.5 + n2**-0.5)

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ended[a], self.seen[a], self.ended[b], self.seen[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                fx, fy = (self.seen[s] if s is not None else 0 for s in (x, y))
                if self._differ(fx, self.seen[a], fy, self.seen[b]):
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of the subtree ``tree`` to ``into`` and below."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ended[a] += self.ended[b]
            for c, y in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], y))
                else:
                    self.next[a][c] = y

    def merged(self) -> list[dict[str, int]]:
        """Settle states one by one: each frontier state is merged into a settled one that it is compatible with, or settled itself."""
        settled = [0]
        while True:
            frontier = [(self.seen[t], s, c, t) for s in settled for c, t in self.next[s].items() if t not in settled]
            if not frontier:
                break
            _, s, c, t = max(frontier, key=lambda x: (x[0], -x[3]))
            same = next((r for r in settled if self.compatible(r, t)), None)
            if same is None:
                settled.append(t)
            else:
                self.next[s][c] = same
                self.fold(same, t)
        place = {s: i for i, s in enumerate(settled)}
        return [{c: place[t] for c, t in self.next[s].items()} for s in settled]


def infer(examples: list[str]) -> Automaton:
    """Automaton of a format: the merged structure, with probabilities counted by running the examples through it."""
    shape = _Tree(examples).merged()
    went: Counter = Counter()
    passed: Counter = Counter()
    ended: Counter = Counter()
    for e in examples:
        s = 0
        for c in map(symbol, e):
            passed[s] += 1
            went[s, c] += 1
            s = shape[s][c]
        passed[s] += 1
        ended[s] += 1
    moves = [{c: (t, went[s, c] / passed[s]) for c, t in m.items() if went[s, c]} for s, m in enumerate(shape)]
    return Automaton(moves, [ended[s] / max(1, passed[s]) for s in range(len(shape))])


class Formats(NamedTuple):
    """Automata of the kinds, that of ordinary tokens, and the least gain in log likelihood per symbol of each kind."""

    kinds: dict[str, Automaton]
    ordinary: Automaton | None
    least: dict[str, float]


def _gain(a: Automaton, other: Automaton | None, token: str) -> float:
    return a.score(token) - (other.score(token) if other else 0.0)


def learn(credentials: dict[str, list[str]], ordinary: list[str]) -> Formats:
    """Formats from labelled credentials and ordinary tokens.  The threshold of a kind lets 19 of 20 of its examples pass, and no ordinary token."""
    plain = infer(ordinary) if ordinary else None
    kinds, least = {}, {}
    for kind, values in credentials.items():
        if len(values) < MIN_EXAMPLES:
            continue
        kinds[kind] = a = infer(values)
        gains = sorted(_gain(a, plain, v) for v in values)
        least[kind] = max([gains[len(gains) // 20], *(_gain(a, plain, v) + 1e-9 for v in ordinary)])
    return Formats(kinds, plain, least)


def learned_spans(text: str, formats: Formats) -> list[Span]:
    """Candidate tokens (16 or more credential characters, a digit among them) whose format is a credential's."""
    out = []
    for m in _CANDIDATE.finditer(text):
        token = m[0]
        if not any(c.isdigit() for c in token):
            continue
        best = max(((_gain(a, formats.ordinary, token) - formats.least[k], k) for k, a in formats.kinds.items()), default=None)
        if best and best[0] >= 0:
            out.append((f"like_{best[1]}", m.start(), m.end()))
    return out


def _examples(most: int):
    """(kind, rank, token) of a task: labelled credentials of all texts, and some ordinary tokens of sampled texts that have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = Least(most)
        for batch in batches:
            for text, sampled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = base_spans(text)
                for span in found:
                    least.add(span[0], (credential(text, span)[:200],))
                plain = {w.strip(".,!?;:") for w in text.split()} if sampled and not found else set()
                # long words, and plain numbers, which look most like a key without being one
                for rule in (str.isalpha, str.isdigit):
                    for w in sorted(w for w in plain if len(w) >= 8 and w.isascii() and rule(w))[:10]:
                        least.add("word" if rule is str.isalpha else "number", (w[:200],))
        columns = list(zip(*least, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["kind", "rank", "token"])

    return work


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = MOST_EXAMPLES, key: str = "doc_id", text: str = "text") -> Formats:
    """Formats learned from at most ``most`` examples of each kind, chosen by hash among all rows, and ordinary tokens of about ``sample_docs`` rows."""
    found = cut_lineage(marked_texts(docs, sample_docs, key, text).mapInArrow(_examples(most), "kind string, rank long, token string")).distinct()
    by_kind: dict[str, list[str]] = {}
    for kind in (*KINDS, "word", "number"):
        rows = found.where(F.col("kind") == kind).orderBy("rank", "token").limit(most).collect()
        by_kind[kind] = [r.token for r in rows]
    ordinary = by_kind.pop("word") + by_kind.pop("number")
    return learn({k: v for k, v in by_kind.items() if v}, ordinary)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long"


def scan(docs: DataFrame, formats: Formats | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every text (columns of ``RESULT``).  Formats are learned from the table unless given."""
    formats = formats or fit(docs, key=key, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                extra = uncovered(learned_spans(t or "", formats), base)
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in KINDS), digest(joined(base, KINDS)), joined(base + extra, (*KINDS, *LEARNED)), len(extra)))
            names = [c.split()[0] for c in RESULT.split(", ")]
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, RESULT)
