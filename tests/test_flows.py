"""Stored index, scorers, budgets, providers, numbers, element trees, header scans and prediction joins."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import budget, cross, elements, evidence, numbering, predictions, reads, rewriting, stored_index
from factloom.operators import lexical as L
from factloom.plans import knowledge_base as kb
from factloom.plans import retrieval
from factloom.sources import headers, pages


def words(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice("alpha beta gamma delta amplifier regulator capacitor overheating rail noise ripple".split()) + draw.choice(["", "", "s", "x1"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"title {i % 7}", f"https://a.example/{i}", words(5 + i % 40, i) + (" rareterm" * (1 + i % 3) if i % 29 == 0 else "")) for i in range(400)]
    return spark.createDataFrame([*rows, (1000, None, None, None), (1001, "", "", "")], "chunk_id long, title string, url string, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, ["rareterm"]), (2, ["Regulator", "ripple"]), (3, ["amp", "rail"]), (4, ["missing"]), (5, ["x1", "ab"]), (6, []), (7, ["capacitors", "capacitor"])]
    return spark.createDataFrame(rows, "q int, fts_terms array<string>")


def as_rows(found):
    return sorted((r.q, r.rank, r.chunk_id, round(r.bm25_score, 9)) for r in found.collect())


@pytest.mark.parametrize("block_chunks", [1024, 16])
def test_stored_index_searches_what_was_written(spark, corpus, asked, tmp_path, block_chunks):
    built = stored_index.build(corpus, str(tmp_path / "ix"), block_chunks=block_chunks, buckets=4)
    opened = stored_index.open_index(spark, str(tmp_path / "ix"))
    assert opened == built and opened.chunks == 402
    want = L.bm25(asked, L.postings(corpus), L.lengths(corpus), "q", 5)
    assert as_rows(stored_index.search(asked, opened, "q", 5)) == as_rows(want)
    assert as_rows(stored_index.search(asked, opened, "q", 5, most_direct=0)) == as_rows(want)


@pytest.mark.parametrize("most", [100_000, 2])
def test_scan_finds_what_an_index_finds(spark, corpus, asked, tmp_path, monkeypatch, most):
    """Carried terms, too many to be carried, repeated rows and null ids."""
    monkeypatch.setattr(L, "MOST_CARRIED", most)
    want = L.bm25(asked, L.postings(corpus), L.lengths(corpus), "q", 5)
    assert as_rows(L.bm25_scan(asked, corpus, "q", 5)) == as_rows(want)
    if most > 2:
        twice = corpus.unionByName(corpus.where("chunk_id % 3 = 0")).unionByName(corpus.limit(3).withColumn("chunk_id", F.lit(None).cast("long")))
        built = stored_index.build(twice, str(tmp_path / "ix"), buckets=4)
        key = lambda found: sorted((r.q, r.rank, str(r.chunk_id), round(r.bm25_score, 9)) for r in found.collect())
        assert key(L.bm25_scan(asked, twice, "q", 40)) == key(stored_index.search(asked, built, "q", 40))


def test_scan_keeps_matches_only(spark, corpus):
    """What a search stores and shuffles are matches of its terms; words that nobody asked for stay where they are."""
    found = L.term_counts(corpus, ["rareterm", "amp", "missing"]).collect()
    assert {r.term for r in found} == {"rareterm", "amp"}
    want = corpus.where("text LIKE '%rareterm%'").count()
    assert sum(r.term == "rareterm" and r.token == "rareterm" for r in found) == want
    assert all(r.token is not None or r.tf > 1 for r in found)


def test_like_scan_cuts_each_term_to_its_first_chunks(spark):
    rows = [(i // 2, "Two words" if i % 3 else None, f"x{i} needle") for i in range(60)]
    texts = spark.createDataFrame(rows, "chunk_id long, title string, text string")
    queries = spark.createDataFrame([(1, ["needle"]), (2, ["two  words", "two words"]), (3, ["x4", " 5"]), (4, ["  "])], "q long, like_terms array<string>")
    got = {q: [r.chunk_id for r in L.like_search(queries, texts, "q", 5).where(F.col("q") == q).orderBy("rank").collect()] for q in (1, 2, 3, 4)}
    brute = lambda test: sorted({c for c, title, text in rows if test((title or "").lower(), text)})[:5]
    assert got[1] == [0, 1, 2, 3, 4] and got[2] == brute(lambda a, b: "two words" in a) and got[4] == []
    assert got[3] == brute(lambda a, b: "x4" in b or " 5" in b)


def test_stored_index_leaves_blocks_that_cannot_matter(spark, tmp_path):
    # block bounds differ: a few chunks hold the term often, the others once
    rows = [(i, "t", "u", "filler " * 30 + "needle " * (20 if i % 100 == 0 else 1)) for i in range(400)] + [(i, "t", "u", "filler other words") for i in range(400, 1200)]
    table = spark.createDataFrame(rows, "chunk_id long, title string, url string, text string")
    index = stored_index.build(table, str(tmp_path / "ix"), block_chunks=10, buckets=2)
    asked = spark.createDataFrame([(1, ["needle"])], "q int, fts_terms array<string>")
    plan = stored_index.plan(asked, index, "q")
    begun, left = stored_index.blocks_to_read(plan, "q", 2)
    assert left.count() < plan.bounds.count() / 2
    want = L.bm25(asked, L.postings(table), L.lengths(table), "q", 2)
    assert as_rows(stored_index.search(asked, index, "q", 2, most_direct=0)) == as_rows(want)


def test_index_without_a_summary_is_not_opened(spark, corpus, tmp_path):
    L.postings(corpus).write.parquet(str(tmp_path / "half" / "postings"))
    with pytest.raises(Exception, match="summary|PATH_NOT_FOUND|complete"):
        stored_index.open_index(spark, str(tmp_path / "half"))


def test_knowledge_base_is_searched_from_its_folder(spark, tmp_path):
    rows = [(i, f"Amplifier page {i}", f"https://h.example/{i}", "\n".join(words(30, 50 * i + k) for k in range(12))) for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, title string, url string, text string").withColumn("text_hash", F.sha1(F.encode("text", "UTF-8")))
    built = kb.basic(table, "page_id")
    kb.write(built, str(tmp_path / "kb"))
    stored = spark.read.parquet(str(tmp_path / "kb" / "chunks"))
    ids = sorted(r.chunk_id for r in stored.collect())
    assert ids == list(range(len(ids))) and ids
    index = stored_index.open_index(spark, str(tmp_path / "kb"))
    queries = spark.createDataFrame([(1, "overheating regulator"), (2, "zz")], "q int, question string")
    chunks = stored.withColumn("text", F.col("chunk_text"))
    found = retrieval.sparse(queries, chunks, "q", "question", index=index)
    plain = retrieval.sparse(queries, chunks, "q", "question")
    key = lambda df: sorted((r.q, r.chunk_id, round(r.bm25_score, 9)) for r in df.collect())
    assert key(found) == key(plain) and found.count() > 0


# ---- scorers


def test_cross_scores_keep_rows_and_reasons(spark):
    def picky(pairs):
        if any("bad" in t for _, t in pairs):
            raise ValueError("bad text")
        return [float("nan") if t == "odd" else float(len(t)) for _, t in pairs]

    rows = [(1, "q", t, i) for i, t in enumerate(["aa", "bad", "cccc", None, "odd", "dddd", "bad too", "eeeee"])] + [(2, None, "bad", 0)]
    table = spark.createDataFrame(rows, "q int, question string, text string, rank int").coalesce(1)
    scored = {(r.q, r["rank"]): (r.cross_score, r.cross_error) for r in cross.score_pairs(table, picky, "question", "text", most_pairs=3, most_chars=12).collect()}
    assert scored[1, 0] == (2.0, None) and scored[1, 3] == (0.0, None)
    assert scored[1, 1] == (None, "ValueError: bad text") and scored[1, 4] == (None, "not a finite number")
    best = sorted((r.q, r.place, r["rank"]) for r in cross.cross_rerank(table, picky, ["q"], "question", "text", "rank", 7).collect())
    assert best == [(1, 1, 7), (1, 2, 2), (1, 3, 5), (1, 4, 0), (1, 5, 3), (1, 6, 1), (1, 7, 4), (2, 1, 0)]
    short = cross.score_pairs(table, lambda pairs: [1.0], "question", "text").where("cross_score IS NULL").count()
    assert short == 0  # a wrong number of scores halves the batch down to single pairs


# ---- budgets and providers


def test_page_reads_stop_after_successes(spark):
    draw = random.Random(4)
    rows = [(k, i, draw.choice(["https://x/a", "https://x/b.PDF", "https://www.onsemi.com/products/z", None]), draw.choice([True, False, None]), draw.random() < 0.2) for k in range(4) for i in range(60)]
    table = spark.createDataFrame(rows, "k int, i int, url string, ok boolean, again boolean")
    got = {(r.k, r.i): r.read_outcome for r in budget.page_reads(table, ["k"], ["i"], F.floor(F.col("i") / 7), "url", F.col("ok"), F.col("again"), 3).collect()}
    for k in range(4):
        used = 0
        for _, i, url, ok, again in (r for r in rows if r[0] == k):
            if used >= 3:
                want = "over_budget"
            elif url and (url.lower().endswith(".pdf") or "onsemi" in url):
                want = "skipped"
            else:
                want = "read" if ok else "fallback" if again else "failed"
                used += want != "failed"
            assert got[k, i] == want


def test_first_provider_with_rows_wins(spark):
    calls = spark.createDataFrame([(1, "a", "boom"), (1, "b", None), (1, "c", None), (2, " A", None), (3, "x", None), (4, "a", None), (4, "a", "again")], "q int, provider string, error string")
    rows = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "c", 3), (3, "x", 4), (4, "a", 5), (5, "b", 6)], "q int, provider string, n int")
    told = {(r.q, r.provider): (r.outcome, r.reason) for r in budget.provider_outcomes(calls, rows, "q", ("a", "b", "c")).collect()}
    assert told == {
        (1, "a"): ("failed", "a: boom"), (1, "b"): ("empty", "b: no results"), (1, "c"): ("won", None), (2, "a"): ("empty", "a: no results"),
        (3, "x"): ("unlisted", None), (4, "a"): ("failed", "a: again"), (5, "b"): ("won", None),
    }
    assert sorted(r.n for r in budget.first_provider(calls, rows, "q", ("a", "b", "c")).collect()) == [2, 3, 6]


# ---- numbers


def test_numbers_are_dense_in_order(spark):
    rows = [(i * 7919 % 5003, "x") for i in range(5003)] + [(None, "n")]
    table = spark.createDataFrame(rows, "k long, v string").repartition(7)
    got = sorted((r.n, r.k) for r in numbering.numbered(table, ["k"], "n", 10).collect())
    assert [n for n, _ in got] == list(range(10, 10 + len(rows)))
    assert [k for _, k in got] == [None, *range(5003)]
    assert numbering.numbered(table.where("false"), ["k"], "n").count() == 0


def test_ids_of_a_page_with_very_many_chunks(spark):
    table = spark.range(100_050).select(F.lit(3).alias("page"), F.col("id").alias("chunk_index")).union(spark.range(5).select(F.lit(4), "id"))
    ids = kb.with_ids(table, "page")
    r = ids.agg(F.min("chunk_id"), F.max("chunk_id"), F.count_distinct("chunk_id")).first()
    assert tuple(r) == (0, 100_054, 100_055)
    assert ids.where("page = 4").agg(F.min("chunk_id")).first()[0] == 100_050


# ---- element trees

PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body class=x><nav><a href=1>menu</a></nav>
<div id="main-content" class="post wide"><p>first <b>bold<p>second <a href='2'>link</a></p></div><!-- no --> tail </section><br/>end <footer>foot</footer></body>"""


def test_element_tree_and_candidates(spark):
    table = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "plain"), (5, "<article></article>")], "id int, html string")
    tree = elements.element_tree(table, "id", "html")
    rows = {r.node: r for r in tree.where("id = 1").collect()}
    for r in rows.values():
        inside = [x for x in rows.values() if r.node < x.node <= r["last"]]
        assert all(x.depth > r.depth for x in inside)
        assert r.parent is None or rows[r.parent].node < r.node <= rows[r.parent]["last"]
    found = {(r.id, r.candidate): r for r in elements.candidates(tree, "id", (".post", "#main-content", "[id*='content']", "p", "section", "nav", "div.wide[class*='os']")).collect()}
    assert set(found) == {(1, "candidate:.post"), (1, "candidate:p"), (1, elements.WHOLE), (4, elements.WHOLE)}
    assert found[1, "candidate:.post"].content == "first\nbold\nsecond\nlink"
    assert found[1, "candidate:p"].content == "first\nbold\nsecond\nlink\nsecond\nlink"
    assert found[1, elements.WHOLE].content == "T & t\nfirst\nbold\nsecond\nlink\ntail\nend"
    assert (found[1, "candidate:.post"].chars, found[1, "candidate:.post"].link_chars) == (19, 4)
    pick = lambda mode: {r.id: r.candidate for r in elements.chosen(elements.candidates(tree, "id"), "id", mode).collect()}
    assert pick("fit") == {1: "candidate:.post", 4: elements.WHOLE}
    assert pick("raw") == {1: elements.WHOLE, 4: elements.WHOLE}
    assert pick("auto")[1] == elements.WHOLE


# ---- heads of files


def test_heads_are_read_and_bodies_only_on_demand(spark, tmp_path):
    root = tmp_path / "pages"
    (root / "deep").mkdir(parents=True)
    for i in range(5):
        (root / ("deep" if i % 2 else ".") / f"page_{i}.md").write_text(f"**标题**: Page {i}\n**链接**: https://h.example/{i}\n" + "body text\n" * 2000, encoding="utf-8")
    (root / "other.txt").write_text("no")
    with open(root / "page_77.md", "wb") as file:  # eight gigabytes that take no disk: reading the whole would not end
        file.write("**标题**: Big\n".encode())
        os.truncate(file.fileno(), 8 << 30)
    heads = headers.scan_heads(spark, [str(root)], max_bytes=0, head_bytes=512)
    rows = {r.page_no: r for r in heads.collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 77}
    assert all(r.bytes_read == len(r.head) == 512 for r in rows.values())
    named = {r.page_no: r.title for r in pages.headers(heads).collect()}
    assert named[77] == "Big" and named[3] == "Page 3"
    limited = headers.scan_heads(spark, [str(root)], max_bytes=1 << 20)
    assert [(r.reject_reason, r.files) for r in headers.rejects(limited).collect()] == [("oversized", 1)]
    assert limited.where("page_no = 77").first().bytes_read == 0
    bodies = headers.with_bodies(limited.where("reject_reason IS NULL AND page_no < 2").drop("head"))
    assert sorted(len(r.content) for r in bodies.collect()) == sorted(os.path.getsize(p) for p in (root / "page_0.md", root / "deep" / "page_1.md"))


def test_two_phases_over_files(spark, tmp_path):
    for i in range(4):
        body = "\n".join(f"电源 芯片 电路 电压 {k} the amplifier output rail was measured at {k} V and the capacitor of {k} uF was replaced" for k in range(12 + i))
        link = "https://h.example/forum" if i else "https://h.example/jobs"
        (tmp_path / f"page_{i}.md").write_text(f"**标题**: 电源 Amplifier {i}\n**链接**: {link}/{i}\n{body}", encoding="utf-8")
    built, never_opened = kb.diagnosis_from_files(spark, [str(tmp_path)], max_bytes=1 << 20)
    outcomes = Counter(r.reject_reason for r in built.funnel.collect()) + Counter(r.reject_reason for r in never_opened.collect())
    assert sum(outcomes.values()) == 4


# ---- predictions


def test_prediction_join_counts_what_it_leaves(spark):
    asked = spark.createDataFrame([("a", 1, "x"), (" a ", 5, "y"), ("b", 2, None), ("z", 3, "w"), (None, 4, "n"), ("  ", 6, "n"), ("d", 7, "old")], "sample_id string, position int, prediction string")
    known = spark.createDataFrame([("a", "qa"), ("b", "qb"), ("c", "qc"), ("d", "qd"), ("a", "again"), (None, "nameless")], "sample_id string, question string")
    joined = predictions.join_predictions(asked, known, done=spark.createDataFrame([("d",), ("d",), ("q",)], "sample_id string"))
    rows = Counter((r.sample_id, r.position, r.outcome) for r in joined.rows.collect())
    assert rows == Counter([
        ("a", 1, "pending"), ("a", 5, "repeated"), ("b", 2, "pending"), ("z", 3, "skipped"), (None, 4, "skipped"), (None, 6, "skipped"),
        ("d", 7, "resumed"), ("c", None, "missing"), (None, None, "missing"),
    ])
    assert joined.counts.get == {"pending": 2, "resumed": 1, "skipped": 3, "missing": 2, "repeated": 1}
    assert joined.pending.count() == 3


def test_batch_evaluation_resumes(spark):
    from factloom.plans.evaluation import evaluate_batch

    known = spark.createDataFrame([(f"s{i}", f"why does part {i} fail", "The regulator overheats because the 5V rail is shorted.") for i in range(4)], "sample_id string, question string, reference string")
    asked = spark.createDataFrame([(f"s{i}", i, "The 5V rail is shorted and the regulator overheats.") for i in range(3)] + [("x", 9, "?")], "sample_id string, position int, prediction string")
    rows, joined = evaluate_batch(asked, known, done=spark.createDataFrame([("s1",)], "sample_id string"))
    done = {r.sample_id: r.final_score for r in rows.collect()}
    assert set(done) == {"s0", "s2"}
    assert Counter(r.outcome for r in joined.rows.collect()) == {"pending": 2, "resumed": 1, "skipped": 1, "missing": 1}


# ---- the high-quality builder


def test_quality_builder_stops_after_kept_pages(spark):
    body = "\n\n".join(f"## Part {k}\nThe amplifier fault was traced: output {k} V at R{k}, because capacitor C{k} failed. How to diagnose: measure the schematic node {k}." for k in range(14))
    rows = [(i, f"amplifier repair {'circuit ' * (i % 3)}{i}", f"https://www.example.com/p/{i % 17}", body.replace("output", f"output{i}") if i % 4 else "too short") for i in range(40)]
    rows += [(100, "amplifier", "https://hackster.io/user", body), (101, "nothing here", "https://h.example/x", body), (102, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, title string, url string, text string").withColumn("text_hash", F.sha1(F.encode("text", "UTF-8")))
    whole = kb.high_quality(table, "page_id", floor=-99)
    told = {r.page_id: r.reject_reason for r in whole.funnel.collect()}
    assert len(told) == len(rows) and told[100] == "host_rules"
    assert all(told[i] is not None for i in range(0, 40, 4))
    kept = [r.page_id for r in whole.pages.orderBy("place").collect()]
    assert len(kept) > 5 and set(kept) == {i for i, reason in told.items() if reason is None}
    few = kb.high_quality(table, "page_id", max_docs=5, floor=-99)
    assert [r.page_id for r in few.pages.orderBy("place").collect()] == kept[:5]
    assert Counter(r.reject_reason for r in few.funnel.collect())["over_limit"] == len(kept) - 5
    assert {r.page_id for r in few.chunks.collect()} <= set(kept[:5])


# ---- reads, arguments, rewriting, evidence


def test_first_acceptable_read_wins(spark):
    rows = [("p", "a", 0.9, 50, None), ("p", "b", 0.9, 500, None), ("p", "c", 0.9, 500, None), ("q", "a", None, None, "boom"), ("q", "b", 0.1, 500, None), ("q", "z", 1.0, 999, None), ("r", "a", 0.9, 0, None)]
    table = spark.createDataFrame(rows, "page string, backend string, quality_score double, clean_chars int, error string")
    told = {(r.page, r.backend): (r.outcome, r.reason) for r in reads.read_cascade(table, "page", ("a", "b", "c"), min_score=0.5, min_chars=100).collect()}
    assert told == {
        ("p", "a"): ("too_short", "a: too_short"), ("p", "b"): ("won", None), ("p", "c"): ("not_reached", None), ("q", "a"): ("failed", "a: boom"),
        ("q", "b"): ("low_score", "b: low_score"), ("q", "z"): ("unlisted", None), ("r", "a"): ("empty", "a: empty"),
    }


def test_arguments_are_checked_in_order(spark):
    specs = {"t": [("a", "string", True), ("n", "integer", True), ("f", "boolean", False)], "off": []}
    cases = {
        '{"a": "x", "n": 1}': None, '{"a": "x", "n": true, "f": false}': None, '{"n": 1}': "missing required argument: a", '{"a": 1, "n": 1}': "a must be of type string",
        '{"a": null, "n": 1.5}': "n must be of type integer", '{"a": "x", "n": null, "f": 1}': "f must be of type boolean", "[]": "arguments must be an object", "{": "arguments must be an object",
    }
    table = spark.createDataFrame([("t", a) for a in cases] + [("off", "{}"), ("new", "{}"), ("t", None)], "tool string, args string")
    got = [(r.tool, r.args, r.p) for r in table.withColumn("p", reads.argument_problem(F.col("tool"), F.col("args"), specs, ("t",))).collect()]
    assert {a: p for t, a, p in got if t == "t" and a is not None} == cases
    assert {t: p for t, a, p in got if t != "t"} == {"off": "tool is disabled", "new": "unknown tool"}
    assert [p for t, a, p in got if a is None] == ["arguments must be an object"]


def test_queries_are_rewritten_with_the_default_words(spark):
    rows = [(1, "", "TL431 反馈补偿 怎么处理 R12 输出 5V"), (2, "TL431 R12", "TL431 反馈补偿 R12 5V"), (3, "原因", "LM358 噪声 问题"), (4, "", ""), (5, "motor noise", "LM358 输出噪声 C7")]
    table = spark.createDataFrame(rows, "k int, q string, question string").withColumn("seed", F.when(F.col("k") == 4, " seeded ").otherwise(""))
    got = {r.k: (r.rule, r.rewritten) for r in rewriting.rewritten(table, rewriting.web_rules(F.col("q"), F.col("question"), F.col("seed"))).collect()}
    assert got[1] == ("from_question", "TL431 反馈补偿 R12 输出 5V electronics troubleshooting")
    assert got[2] == ("kept", "TL431 R12")
    assert got[3] == ("only_generic", "LM358 噪声 electronics troubleshooting")
    assert got[4] == ("from_seed", "seeded")
    assert got[5] == ("key_terms_added", "motor noise LM358 输出噪声 C7")
    local = {r.k: (r.rule, r.rewritten) for r in rewriting.rewritten(table, rewriting.local_rules(F.col("q"), F.col("question"), F.col("seed"))).collect()}
    assert local[2][0] == "expanded" and local[2][1].startswith("TL431 R12 ") and "feedback loop" in local[2][1]
    planned = table.where("k = 1").select(rewriting.planned_queries(F.col("question")).alias("p")).first().p
    assert planned[0].startswith("TL431") and planned[0].endswith("原因 处理 电子电路") and len(planned) == 3
    assert table.where("k = 5").select(rewriting.answer_hints(F.col("question")).alias("h")).first().h == ["LM358", "输出噪声", "C7"]


def test_evidence_that_repeats_leaves_and_cautions_are_added(spark):
    rows = [(1, 1, "S", "local_kb_chunk", "same  text", "t", 1.0), (1, 2, " s ", "local_kb_chunk", "Same text", "t", 2.0), (1, 3, "s", "web_page", "same text", "t", 0.5), (2, 1, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "q int, place int, source string, kind string, content string, title string, score double")
    kept = evidence.unique_evidence(table, "q", "place")
    assert sorted((r.q, r.place) for r in kept.collect()) == [(1, 1), (1, 3)]
    context = evidence.answer_context(kept, "q", cautions=evidence.CAUTIONS).first().context
    assert context.startswith("[1] 类型:local_kb_chunk") and context.count("注意:") == 1
