"""Filter audit, vector codes and b-bit MinHash against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import interactions, minhash, vector_codes
from .conftest import prose
from .test_operators import WORD, brute_components


# ---- filter audit


def test_gallop_and_merges_equal_sets():
    draw = random.Random(3)
    for _ in range(300):
        lists = [sorted(draw.sample(range(60), draw.randrange(0, 40))) for _ in range(draw.randrange(0, 5))]
        whole = interactions.union(lists)
        assert whole == sorted(set().union(*lists))
        for items in lists:
            other = sorted(draw.sample(range(60), draw.randrange(0, 50)))
            assert interactions.difference(items, other) == sorted(set(items) - set(other))
            assert interactions.common(items, other) == len(set(items) & set(other))
            for target in (-1, 0, 17, 59, 60):
                at = draw.randrange(0, len(items) + 1)
                assert interactions.gallop(items, target, at) == next((i for i in range(at, len(items)) if items[i] >= target), len(items))


def brute_audit(rows, labels):
    """rows: (doc_id, text, source)"""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    marks = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        marks[i][0] |= quality == 1
        marks[i][1] |= toxic == 1
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        parts[s or ""].append(({f for f, x in fails.items() if x}, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("batch", [10000, 7])
def test_filter_audit(spark, docs, texts, empty, batch):
    more = [(500 + i, "BIG Words $ " * (1 + 40 * i) + prose(5 * i, i), None) for i in range(8)] + [(None, texts[0][1], "src0"), (None, None, "src0")]
    extra = spark.createDataFrame([(i, t, s, "en", 0, 1, "y") for i, t, s in more], docs.schema)
    known = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(300, None, None), (5, 1, 1), (5, 0, None), (None, 1, 1), (403, 1, 0)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in interactions.filter_audit(docs.union(extra), labels).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_audit([*texts, *more], [k for k in known if k[0] is not None])
    assert interactions.filter_audit(empty, labels).count() == 0
    assert {r.good_lost for r in interactions.filter_audit(docs, labels.where("false")).collect()} == {0}


def test_posting_lists_hold_the_failing_ids(spark, docs, texts):
    lists = interactions.posting_lists(interactions.labelled(interactions.failures(docs), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    short = sorted(i for i, t, s in texts if len(WORD.findall(t or "")) < 200)
    assert sorted(row.ids[p] for row in lists for p in row.failing[0]) == short
    assert all(list(row.ids) == sorted(row.ids) for row in lists)


# ---- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label); plain Lloyd with Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], k) for i, v, k in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1])
    cuts = [p * size // parts for p in range(parts + 1)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    seeds = [first[i] for i in sorted(first)[:entries]]
    books = [[s[a:b] for s in seeds] for a, b in itertools.pairwise(cuts)]

    def nearest(v):
        return [min((sum((x - y) ** 2 for x, y in zip(v[cuts[p] : cuts[p + 1]], e)), j) for j, e in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        found = [nearest(v) for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[cuts[p] : cuts[p + 1]] for (_, v, _), f in zip(kept, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = [nearest(v) for _, v, _ in kept]
    sums = Counter()
    for (_, _, k), f in zip(kept, found):
        sums[k] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), sums[k], digest) for (i, _, k), f in zip(kept, found))


def vectors_of(n, size, seed, tie=False):
    draw = np.random.default_rng(seed)
    table = draw.normal(size=(n, size)) + 3 * draw.integers(0, 3, (n, 1))
    table = np.round(table) / 4096 if tie else table
    rows = [(int(i) * 3, [float(np.float32(x)) for x in v], int(i) % 4 if i % 7 else None) for i, v in enumerate(table)]
    return [*rows, (2, None, 1), (4, [0.0] * (size - 1) + [float("nan")], 1), (5, [float("inf")] + [0.0] * (size - 1), None), (7, [None] + [0.0] * (size - 1), 2), rows[1], rows[-1], (0, [0.5] * size, 1)]


@pytest.mark.parametrize(("n", "size", "tie", "slice_"), [(150, 16, False, 2_000_000), (150, 16, True, 100), (9, 11, False, 2_000_000)])
def test_vector_codes(spark, monkeypatch, n, size, tie, slice_):
    monkeypatch.setattr(vector_codes, "SLICE", slice_)
    rows = vectors_of(n, size, 5, tie)
    table = spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    got = Counter(tuple(r) for r in vector_codes.encode(table).collect())
    assert got == brute_codes(rows)


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.encode(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0] * 8, "a"), (1, [1e300, -1e300] * 4, None), (2, [1.0] * 8, "a"), (3, [1.0] * 9, "b")]
    got = vector_codes.encode(spark.createDataFrame(rows, schema)).collect()
    assert {r.vec_id for r in got} == {None, 1, 2}
    assert all(r.error == 0 for r in got)


def test_active_entries_equal_full_scans():
    draw = np.random.default_rng(2)
    rows = draw.integers(-20, 20, (400, 12)).astype(np.int64)
    books = vector_codes.Codebooks.seeded(rows[:5].tolist(), 3)
    codes, far = np.zeros((400, 3), np.int64), np.zeros((400, 3), np.int64)
    books.assign(rows, codes, far, known=False)
    for _ in range(6):
        total = books.sums(rows, codes)
        split = sum(e.size for e in books.entries)
        books = books.updated(total[:split], total[split:])
        books.assign(rows, codes, far, known=True)
        again, apart = np.zeros_like(codes), np.zeros_like(far)
        books.assign(rows, again, apart, known=False)
        assert (again == codes).all() and (apart == far).all()


# ---- MinHash


@pytest.mark.parametrize(
    ("n", "percent", "options"),
    [(3, 85, {}), (5, 80, {}), (3, 80, {"most_elements": 10, "chunk": 3}), (3, 85, {"most_classes": 3, "chunk": 2})],
)
def test_near_duplicates(spark, docs, texts, n, percent, options):
    # chains of texts that each differ a little from the one before, so that components have many links
    rows = list(texts)
    words = prose(120, 991).split()
    for k in range(14):
        words = [*words]
        words[(k * 8) % 120] = f"step{k}"
        rows.append((600 + k, " ".join(words), "chain"))
    table = docs.union(spark.createDataFrame([(i, t, s, "en", 0, 1, "y") for i, t, s in rows[len(texts) :]], docs.schema))
    want = brute_components(rows, n, percent)
    got = minhash.join(table, n=n, percent=percent, **options).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_keys(spark, docs, empty):
    base = prose(100, 5).split()
    near = [*base]
    near[0] = "other"
    rows = [(9, " ".join(base)), (None, " ".join(near)), (4, " ".join([*near[:-1], "end"])), (4, "alone here now"), (None, "nobody else"), (None, None), (8, "a b c d"), (7, "A b\tc D")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.join(table, percent=80).collect())
    assert got == Counter([(9, 4, False), (None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (None, None, True), (8, 7, False), (7, 7, True)])
    assert minhash.join(empty).count() == 0


def test_estimates_follow_the_similarity():
    draw = np.random.default_rng(7)
    for share in (0.3, 0.6, 0.85, 0.95):
        errors = []
        for _ in range(12):
            pool = np.unique(draw.integers(0, 2**63, 3000).astype(np.uint64))
            common = int(len(pool) * share)
            half = (len(pool) - common) // 2
            a, b = np.sort(pool[: common + half]), np.sort(np.concatenate([pool[:common], pool[common + half :]]))
            sets = np.concatenate([a, b])
            planes = minhash.packed(minhash.minima(sets, np.array([0, len(a), len(sets)])))
            errors.append(float(minhash.estimate(minhash.agreeing(planes[0], planes[1]))) - common / len(pool))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_signatures_in_columns_agree_with_numpy(spark):
    draw = np.random.default_rng(8)
    words = draw.integers(-(2**63), 2**63, (20, minhash.BITS * minhash.WORDS))
    table = spark.createDataFrame([(i, words[i].tolist(), words[(i * 7) % 20].tolist()) for i in range(20)], "i int, x array<long>, y array<long>")
    for r in table.select("i", minhash.agreeing_column("x", "y").alias("n")).collect():
        assert r.n == int(minhash.agreeing(words[r.i], words[(r.i * 7) % 20]))


def test_bands_and_estimates_miss_almost_nothing():
    missed = (1 - 0.85**minhash.ROWS) ** minhash.BANDS
    assert missed < 1e-9
    assert minhash.estimate(np.array([minhash.least_places(85)]))[0] > 0.6
