"""Streams: loop budgets as keyed state over restarts, lines that leave with a reason."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.streaming.budgets import TOOL_BUDGETS, guard, guard_stream
from factloom.streaming.resume import resume_stream

SCHEMA = "sample_id string, step long, tool_name string, ts timestamp"


def actions(seed, samples=5, steps=40):
    draw = random.Random(seed)
    tools = [*TOOL_BUDGETS, "agent_planner"]
    return [(f"s{k}", i, draw.choice(tools), f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}") for k in range(samples) for i in range(steps)]


def run(spark, src, out, check, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = spark.readStream.schema(SCHEMA).json(str(src))
    found = guard_stream(log, "sample_id", "step", "ts", **options)
    query = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def write(path, rows):
    path.write_text("".join(json.dumps(dict(zip(("sample_id", "step", "tool_name", "ts"), r))) + "\n" for r in rows))


def test_budgets_go_on_after_a_restart(spark, tmp_path):
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    rows = actions(3)
    write(src / "a.json", [r for r in rows if r[1] < 17])
    run(spark, src, out, check)
    write(src / "b.json", [r for r in rows if r[1] >= 17])
    run(spark, src, out, check)  # a new query from the checkpoint
    got = {(r.sample_id, r.step): r.outcome for r in spark.read.parquet(str(out)).collect()}
    table = spark.createDataFrame(rows, "sample_id string, step long, tool_name string, ts string")
    want = {(r.sample_id, r.step): "executed" if r.executed else "over_budget" for r in guard(table, ["sample_id"], "step", F.floor(F.col("step") / 8)).collect()}
    assert got == want


def test_samples_run_out_of_time(spark, tmp_path):
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    rows = actions(4, samples=2, steps=50)
    write(src / "a.json", [r for r in rows if r[1] < 25])
    run(spark, src, out, check, seconds=30.0)
    write(src / "b.json", [r for r in rows if r[1] >= 25])
    run(spark, src, out, check, seconds=30.0)
    got = spark.read.parquet(str(out)).collect()
    assert len(got) == len(rows)
    assert {r.step for r in got if r.outcome == "out_of_time"} == set(range(30, 50))


def test_unusable_lines_leave_with_a_reason(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text('{"sample_id": "1", "n": 4}\n\n{"sample_id": \n{"sample_id": " ", "n": 1}\n{"n": 2}\n{"sample_id": "2", "n": "many"}\n[1]\n')
    args = (spark, str(src), "sample_id string, n int", sink)
    resume_stream(*args, str(tmp_path / "c1"), "sample_id", lambda df: df).awaitTermination(60)
    (src / "b.json").write_text('{"sample_id": "1", "n": 5}\n{"sample_id": "3", "n": 6}\nnope\n')
    resume_stream(*args, str(tmp_path / "c1"), "sample_id", lambda df: df).awaitTermination(60)
    assert sorted((r.sample_id, r.n) for r in spark.read.parquet(sink).collect()) == [("1", 4), ("3", 6)]
    told = Counter(r.reason for r in spark.read.parquet(f"{sink}.rejects").collect())
    assert told["not_json"] == 2 and told["no_key"] == 2 and sum(told.values()) == 6
