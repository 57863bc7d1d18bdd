"""Analytics over the event log of tool runs.

An event has ``sample_id, step, tool_name, action, success, elapsed_seconds,
error`` and JSON ``inputs``/``outputs``.  Predictions that carry their trace as
an array are exploded with :func:`events`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_text, top_k

RETRIEVE = "local_retrieve"
ANSWER_TOOLS = ("evidence_rank", "finish_answer")
COUNTERS = (
    "kb_candidate_count", "kb_used_count", "kb_discarded_count", "noise_filtered_count",
    "low_value_source_filtered_count", "low_value_project_filtered_count",
    "required_terms_filtered_count", "high_relevance_count",
)


def events(predictions: DataFrame) -> DataFrame:
    return predictions.select("sample_id", F.posexplode("tool_trace").alias("step", "_e")).select("sample_id", "step", "_e.*")


def number(json: str, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, path).try_cast("long"), F.lit(0))


def action_counts(log: DataFrame) -> DataFrame:
    named = log.filter(F.coalesce("tool_name", F.lit("")) != "")
    return named.groupBy("tool_name").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.sum("elapsed_seconds"), 4).alias("elapsed"),
    )


def tool_sequences(log: DataFrame, keys: list[str], step: str, bucket: Column, k: int = 10) -> DataFrame:
    """Most frequent orders in which samples called their tools."""
    per_sample = ordered_text(log, keys, step, bucket, "tool_name", ">", "sequence")
    counted = per_sample.groupBy("sequence").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "sequence").limit(k)


def trace_stats(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per sample: events, outcomes, planner and search steps, distinct tools."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("event_count"),
        F.count_if("success").alias("successful_events"),
        F.count_if(~F.col("success")).alias("failed_events"),
        F.count_if(F.col("tool_name") == "agent_planner").alias("planner_events"),
        F.count_if(F.col("tool_name") == "web_search").alias("search_events"),
        F.count_if(F.get_json_object("outputs", "$.recoverable_error").isNotNull()).alias("recoverable_errors"),
        F.array_join(F.array_sort(F.collect_set("tool_name")), ",").alias("tools"),
    )


def retrieval_diagnostics(log: DataFrame) -> DataFrame:
    """Totals over all retrieval calls."""
    calls = log.filter((F.col("tool_name") == RETRIEVE) | (F.col("action") == "circuit_md_fts_search"))
    sources = F.coalesce(F.json_array_length(F.get_json_object("outputs", "$.sources")), F.lit(0))
    count = F.greatest(number("outputs", "$.metadata.chunks"), number("outputs", "$.evidence_delta"), sources)
    staged = calls.withColumn("_count", count)
    fallback = {"kb_candidate_count", "kb_used_count"}

    def counter(name: str) -> Column:
        raw = number("outputs", f"$.metadata.{name}")
        return F.sum(F.when(raw == 0, F.col("_count")).otherwise(raw) if name in fallback else raw).alias(name)

    summed = staged.agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("_count") > 0).alias("_nonempty"),
        F.coalesce(F.sum("_count"), F.lit(0)).alias("_chunks"),
        *[counter(n) for n in COUNTERS],
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return (
        summed.withColumn("nonempty_rate", ratio("_nonempty", "calls"))
        .withColumn("avg_chunks", ratio("_chunks", "calls"))
        .withColumn("high_relevance_rate", ratio("high_relevance_count", "kb_used_count"))
        .drop("_nonempty", "_chunks")
    )


# fixed values: what an answer with knowledge base evidence names, any one group in full
KB_MARKS = (("local_kb_chunk",), ("本地", "知识库"))


def retrieval_usage(predictions: DataFrame, log: DataFrame, order: str = "step", marks: tuple[tuple[str, ...], ...] = KB_MARKS) -> DataFrame:
    """One row: samples that chose the knowledge base, share of answers that show its evidence, and the index of the last call that named one.

    ``predictions`` has ``selected`` (tool names) and ``answer`` per sample.  No row where nobody chose it and nothing called it.
    """
    answer = F.coalesce("answer", F.lit(""))
    shown = F.lit(False)
    for group in marks:
        every = F.lit(True)
        for mark in group:
            every = every & F.contains(answer, F.lit(mark))
        shown = shown | every
    chosen = predictions.agg(
        F.count_if(F.array_contains("selected", RETRIEVE)).alias("local_retrieve_selected_samples"),
        F.coalesce(F.round(F.avg(shown.cast("double")), 4), F.lit(0.0)).alias("kb_evidence_used_rate"),
    )
    calls = log.filter((F.col("tool_name") == RETRIEVE) | (F.col("action") == "circuit_md_fts_search"))
    field = lambda path: F.nullif(F.get_json_object("outputs", path), F.lit(""))
    path = F.coalesce(field("$.metadata.index_status.db_path"), field("$.metadata.index_dir"))
    exists = field("$.metadata.index_status.exists")
    exists = F.when(exists.isin("true", "false"), exists == "true")
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    index = calls.agg(
        F.count("*").alias("local_retrieve_calls"), F.coalesce(last(path), F.lit("")).alias("index_path"), last(exists).alias("index_exists")
    )
    # one row each
    both = chosen.withColumn("_one", F.lit(1)).join(index.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.filter("local_retrieve_calls > 0 OR local_retrieve_selected_samples > 0")


# fixed values: how a sample used the knowledge base
BUCKET_NAMES = {
    "not_called": "KB未调用", "nothing_found": "KB无高相关结果", "discarded": "KB候选被丢弃", "in_answer": "KB进入答案",
}


def kb_buckets(log: DataFrame, samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Bucket per sample.  ``log`` has ``kb_in_answer`` for answer steps."""
    call = F.col("tool_name") == RETRIEVE
    per_sample = log.groupBy(sample).agg(
        F.count_if(call).alias("_calls"),
        F.sum(F.when(call, number("outputs", "$.metadata.kb_candidate_count")).otherwise(0)).alias("_found"),
        F.bool_or(F.col("tool_name").isin(*ANSWER_TOOLS) & F.col("kb_in_answer")).alias("_used"),
    )
    b = BUCKET_NAMES
    bucket = (
        F.when(F.coalesce("_calls", F.lit(0)) == 0, b["not_called"])
        .when(F.col("_used"), b["in_answer"])
        .when(F.col("_found") == 0, b["nothing_found"])
        .otherwise(b["discarded"])
    )
    return samples.select(sample).distinct().join(per_sample, sample, "left").select(sample, bucket.alias("bucket"))


def bucket_report(buckets: DataFrame, deltas: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Mean delta and wins per bucket; buckets without samples are kept."""
    joined = deltas.select(sample, "delta").join(buckets, sample)
    wide = joined.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("bucket"),
                    F.count_if(F.col("bucket") == name).alias("samples"),
                    F.coalesce(F.round(F.avg(F.when(F.col("bucket") == name, F.col("delta"))), 4), F.lit(0.0)).alias("average_delta"),
                    F.count_if((F.col("bucket") == name) & (F.col("delta") > 0)).alias("improved"),
                    F.count_if((F.col("bucket") == name) & (F.col("delta") < 0)).alias("regressed"),
                )
                for name in BUCKET_NAMES.values()
            ]
        ).alias("_b")
    )
    return wide.select(F.inline("_b"))


def runtime_stats(predictions: DataFrame) -> DataFrame:
    """Fallback finishes and answer timeouts over predictions with
    ``final_stop_reason``, ``error_text`` and ``answer_error``."""
    timed_out = F.contains(F.lower("error_text"), F.lit("timed out"))
    return predictions.agg(
        F.count("*").alias("samples"),
        F.count_if(F.contains("final_stop_reason", F.lit("fallback finish"))).alias("fallback_finish_count"),
        F.round(F.avg(F.contains("final_stop_reason", F.lit("fallback finish")).cast("double")), 4).alias("fallback_finish_rate"),
        F.count_if(timed_out & F.col("answer_error")).alias("final_answer_timeout_count"),
    )


def token_usage(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in columns]
    return (df.groupBy(*keys) if keys else df).agg(*sums)


def compact_steps(log: DataFrame) -> DataFrame:
    """Readable steps: planner choices, rejected choices, tool results.

    Bootstrap events are left out; tool results carry the number of the planner
    step they belong to.
    """
    planner = F.col("tool_name") == "agent_planner"
    boot = (planner & (F.col("action") == "initialize_loop")) | (F.col("tool_name") == "openhands_sdk")
    role = F.when(planner, "assistant").otherwise("tool")
    chosen = F.coalesce(
        F.get_json_object("outputs", "$.effective_action.tool_name"),
        F.get_json_object("outputs", "$.validated_action.tool_name"),
    )
    return log.filter(~boot).select(
        "sample_id",
        "step",
        role.alias("role"),
        F.when(planner & (F.col("action") == "select_action"), chosen)
        .when(planner, F.col("summary"))
        .otherwise(F.col("tool_name"))
        .alias("content"),
        F.get_json_object("inputs", "$.query").alias("query"),
        "success",
        "error",
    )


def last_items(log: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Last ``k`` entries per key, as kept for a planner."""
    return top_k(log, keys, [F.desc(order)], k, "from_end")
