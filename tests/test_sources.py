import json

from pyspark.sql import functions as F

from factloom.plans import knowledge_base as kb
from factloom.plans import retrieval
from factloom.sources import catalog, images, jsonl, pages, predictions, samples, traces
from factloom.streaming.resume import resume_stream


def test_id_list_and_json(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# note\nb\n\na\nb\n", encoding="utf-8")
    got = jsonl.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()
    assert [r["id"] for r in got] == ["b", "a"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n', encoding="utf-8")
    assert jsonl.read(spark, str(tmp_path / "x.jsonl"), "a int", tolerant=True).count() == 2
    df = spark.createDataFrame([("bad\x00", float("nan"))], "s string, d double")
    jsonl.append(df, str(tmp_path / "out"))
    written = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(written) == {"s": "bad�"}


def test_dataset_samples(spark, tmp_path):
    row = {
        "post_id": "7",
        "messages": [
            {"role": "system", "content": "s"},
            {"role": "user", "content": [{"type": "text", "text": " one "}, {"type": "image_url", "image_url": {"url": "p/x.png"}}]},
            {"role": "user", "content": "two"},
            {"role": "assistant", "content": "first"},
            {"role": "assistant", "content": "last"},
        ],
    }
    (tmp_path / "d.jsonl").write_text(json.dumps(row) + "\n", encoding="utf-8")
    got = samples.parse_dataset(samples.read_dataset(spark, str(tmp_path / "d.jsonl"))).first()
    assert (got["sample_id"], got["question"], got["reference"], got["images"]) == ("7", "one\ntwo", "last", ["p/x.png"])


def test_page_files_build_and_search(spark, tmp_path):
    root = tmp_path / "crawl"
    root.mkdir()
    body = {
        1: ("LED blinker notes", "https://a.org/led", "A simple LED circuit with a resistor and a capacitor for blinking. " * 8),
        2: ("LM358 current sense amplifier", "https://a.org/sense", "The LM358 amplifies the shunt voltage in this current sense circuit. " * 8),
        3: ("Object moved", "https://a.org/moved", "Object moved here"),
    }
    for n, (title, link, text) in body.items():
        (root / f"page_{n}.md").write_text(f"**标题**: {title}\n**链接**: {link}\n**发布时间**: 2024-01-01\n\n{text}\n", encoding="utf-8")
    files = pages.scan(spark, [str(root)])
    assert [r["title"] for r in pages.headers(files).orderBy("page_no").collect()][0] == "LED blinker notes"
    raw = files.withColumn("raw", pages.decode(F.col("content"))).drop("content")
    parsed = pages.parse(raw, "raw", "path")
    built = kb.basic(parsed, "page_no")
    assert {r["outcome"]: r["pages"] for r in kb.counters(built.funnel).collect()} == {"kept": 2, "short": 1}
    chunks = built.chunks.drop("text").withColumnRenamed("chunk_text", "text")
    queries = spark.createDataFrame([(1, "LM358 current sense amplifier")], "qid int, question string")
    from factloom.operators import lexical

    ranked = lexical.rerank(retrieval.sparse(queries, chunks, "qid", "question"), "question")
    found = retrieval.sparse_search(ranked, "qid").filter("discard_reason is null").orderBy(F.desc("rerank_score"))
    assert found.first()["title"] == "LM358 current sense amplifier"
    kb.write(built, str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb/postings")).count() > 0


def test_forbidden_root():
    import pytest

    with pytest.raises(ValueError):
        pages.check_root("/data/tests/part", ("/data/tests",))
    assert pages.check_root("/data/testset", ("/data/tests",)) == "/data/testset"


def test_catalog(spark):
    payload = {"url": "https://x/product/C123.html", "name": "n", "prices": [{"start": str(i), "price": "0.1"} for i in range(6)]}
    got = catalog.normalise(spark.createDataFrame([(json.dumps(payload),), ("{}",)], "p string"), "p").collect()
    assert got[0]["c_number"] == "C123" and got[0]["price_str"].count("|") == 3 and got[1]["price_str"] == "暂无报价"


def test_predictions(spark):
    df = spark.createDataFrame([("", "p1", "", "text", ["e"]), ("s2", "", "ok", "", [])], "sample_id string, post_id string, answer string, generated_answer string, errors array<string>")
    got = predictions.normalise(df)
    assert sorted((r["sample_id"], r["answer"]) for r in got.collect()) == [("p1", "text"), ("s2", "ok")]
    assert [r["sample_id"] for r in predictions.failed_ids(got).collect()] == ["p1"]


def test_images(spark, tmp_path):
    root = tmp_path / "img"
    (root / "7" / "deep").mkdir(parents=True)
    (root / "7" / "x.png").write_bytes(b"abc")
    (root / "7" / "deep" / "x.png").write_bytes(b"abc")
    refs = spark.createDataFrame([("7", "http://h/x.png?y=1"), ("7", "z.png")], "post_id string, original_url string")
    got = {r["original_url"]: r for r in images.resolve(refs, images.listing(spark, str(root))).collect()}
    assert got["http://h/x.png?y=1"]["path"].endswith("7/x.png") and not got["z.png"]["exists"]
    assert images.data_urls(spark, str(root)).first()["data_url"] == "data:image/png;base64,YWJj"


def test_trace_store(spark, tmp_path):
    log = spark.createDataFrame(
        [("s", 0, "agent_planner", "initialize_loop", "", None, None, True, None), ("s", 1, "agent_planner", "select_action", "", None, '{"validated_action": {"tool_name": "web_search"}}', True, None),
         ("s", 2, "web_search", "run", "", '{"query": "q"}', None, False, "boom")],
        "sample_id string, step int, tool_name string, action string, summary string, inputs string, outputs string, success boolean, error string",
    )
    traces.write(log, str(tmp_path / "t"), 4)
    assert [tuple(r) for r in traces.listing(spark, str(tmp_path / "t")).collect()] == [("s", 2, 1)]
    assert traces.load(spark, str(tmp_path / "t"), "s", 4).orderBy("step").first()["content"] == "web_search"


def test_resume_stream_adds_each_sample_once(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text('{"sample_id": "1"}\n{"sample_id": "2"}\n{"sample_id": "1"}\n')
    work = lambda df: df.withColumn("answer", F.lit("x"))
    args = (spark, str(src), "sample_id string", sink)
    resume_stream(*args, str(tmp_path / "c1"), "sample_id", work).awaitTermination(60)
    (src / "b.json").write_text('{"sample_id": "2"}\n{"sample_id": "3"}\n')
    resume_stream(*args, str(tmp_path / "c2"), "sample_id", work).awaitTermination(60)
    assert sorted(r["sample_id"] for r in spark.read.parquet(sink).collect()) == ["1", "2", "3"]
