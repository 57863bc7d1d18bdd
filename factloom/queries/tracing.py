"""Analytics over the event log of tool runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import ordered as O
from ..operators import trace as T
from ..streaming import budgets
from . import query
from .base import LOG, log, q, table
from .runs import DELTAS, _deltas

# a retrieval step reports k candidates, a third of them discarded
_OUTPUTS = """CASE WHEN tool_name = 'local_retrieve' THEN CASE WHEN k % 4 = 0 THEN 0 ELSE k END ELSE 0 END"""


def _with_outputs(spark, sf):
    base = log(spark, sf)
    found = F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("k"))
    meta = F.struct(
        F.struct(
            found.alias("kb_candidate_count"),
            F.floor(found / 2).alias("kb_used_count"),
            F.floor(found / 3).alias("kb_discarded_count"),
            F.floor(found / 5).alias("high_relevance_count"),
            F.floor(found / 2).alias("chunks"),
        ).alias("metadata")
    )
    return base.withColumns(
        {
            "outputs": F.when(F.col("tool_name") == "local_retrieve", F.to_json(meta)),
            "inputs": F.to_json(F.struct(F.concat(F.lit("query "), F.col("k").cast("string")).alias("query"))),
            "action": F.when(F.col("tool_name") == "agent_planner", F.when(F.col("k") < 50, "select_action").otherwise("rejected_action")).otherwise("run"),
            "kb_in_answer": F.col("k") % 2 == 1,
        }
    )


@query(
    "action_counts",
    f"""WITH {LOG} SELECT tool_name, count(*) AS n, count(*) FILTER (WHERE NOT success) AS failed, round(sum(elapsed_seconds), 4) AS elapsed FROM log GROUP BY tool_name""",
)
def action_counts(spark, sf):
    return T.action_counts(log(spark, sf))


@query(
    "tool_sequences",
    f"""WITH {LOG}, s AS (SELECT sample_id, string_agg(tool_name, '>' ORDER BY step) AS sequence FROM log GROUP BY sample_id)
      SELECT sequence, count(*) AS n FROM s GROUP BY sequence ORDER BY n DESC, sequence LIMIT 10""",
)
def tool_sequences(spark, sf):
    return T.tool_sequences(log(spark, sf), ["sample_id"], "step", F.col("slot"))


@query(
    "trace_stats",
    f"""WITH {LOG} SELECT sample_id, count(*) AS event_count, count(*) FILTER (WHERE success) AS successful_events, count(*) FILTER (WHERE NOT success) AS failed_events,
        count(*) FILTER (WHERE tool_name = 'agent_planner') AS planner_events, count(*) FILTER (WHERE tool_name = 'web_search') AS search_events, 0::BIGINT AS recoverable_errors,
        string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools FROM log GROUP BY sample_id""",
)
def trace_stats(spark, sf):
    return T.trace_stats(_with_outputs(spark, sf), ["sample_id"])


@query(
    "kb_diagnostics",
    f"""WITH {LOG}, c AS (SELECT {_OUTPUTS} AS found FROM log WHERE tool_name = 'local_retrieve'),
      n AS (SELECT found, found // 2 AS cnt FROM c),
      s AS (SELECT count(*) AS calls, count(*) FILTER (WHERE cnt > 0) AS ne, sum(cnt) AS ch, CAST(sum(CASE WHEN found = 0 THEN cnt ELSE found END) AS BIGINT) AS kb_candidate_count,
        CAST(sum(CASE WHEN found // 2 = 0 THEN cnt ELSE found // 2 END) AS BIGINT) AS kb_used_count, CAST(sum(found // 3) AS BIGINT) AS kb_discarded_count, 0::BIGINT AS noise_filtered_count,
        0::BIGINT AS low_value_source_filtered_count, 0::BIGINT AS low_value_project_filtered_count, 0::BIGINT AS required_terms_filtered_count, CAST(sum(found // 5) AS BIGINT) AS high_relevance_count FROM n)
      SELECT * EXCLUDE (ne, ch), round(ne / CAST(calls AS DOUBLE), 4) AS nonempty_rate, round(ch / CAST(calls AS DOUBLE), 4) AS avg_chunks,
        round(high_relevance_count / CAST(kb_used_count AS DOUBLE), 4) AS high_relevance_rate FROM s""",
)
def kb_diagnostics(spark, sf):
    return T.retrieval_diagnostics(_with_outputs(spark, sf))


_B = T.BUCKET_NAMES
_BUCKETS = f"""{LOG}, agg AS (SELECT sample_id, count(*) FILTER (WHERE tool_name = 'local_retrieve') AS calls, sum({_OUTPUTS}) AS found,
     bool_or(tool_name IN ('evidence_rank', 'finish_answer') AND k % 2 = 1) AS used FROM log GROUP BY 1),
  buckets AS (SELECT sample_id, CASE WHEN calls = 0 THEN {q(_B['not_called'])} WHEN used THEN {q(_B['in_answer'])} WHEN found = 0 THEN {q(_B['nothing_found'])} ELSE {q(_B['discarded'])} END AS bucket FROM agg)"""


@query("kb_buckets", f"WITH {_BUCKETS} SELECT bucket, count(*) AS samples FROM buckets GROUP BY bucket")
def kb_buckets(spark, sf):
    events = _with_outputs(spark, sf)
    return T.kb_buckets(events, events).groupBy("bucket").agg(F.count("*").alias("samples"))


@query(
    "kb_bucket_report",
    f"""WITH {DELTAS}, {_BUCKETS}, u AS (SELECT 'P' || split_part(sample_id, '@', 1) AS sample_id, max(bucket) AS bucket FROM buckets GROUP BY 1),
      j AS (SELECT bucket, delta FROM deltas JOIN u USING (sample_id)), n(bucket) AS (VALUES {", ".join(f"({q(v)})" for v in _B.values())})
      SELECT n.bucket, count(delta) AS samples, coalesce(round(avg(delta), 4), 0.0) AS average_delta, count(*) FILTER (WHERE delta > 0) AS improved, count(*) FILTER (WHERE delta < 0) AS regressed
      FROM n LEFT JOIN j USING (bucket) GROUP BY n.bucket""",
)
def kb_bucket_report(spark, sf):
    """Users stand for parts of the compared runs; a user's bucket is the last by name."""
    events = _with_outputs(spark, sf)
    buckets = T.kb_buckets(events, events).select(
        F.concat(F.lit("P"), F.substring_index("sample_id", "@", 1)).alias("sample_id"), "bucket"
    )
    per_user = buckets.groupBy("sample_id").agg(F.max("bucket").alias("bucket"))
    return T.bucket_report(per_user, _deltas(spark, sf))


@query(
    "error_streaks",
    f"""WITH {LOG}, g AS (SELECT user_id, success, step, count(*) FILTER (WHERE success) OVER (PARTITION BY user_id ORDER BY ts, step) AS island FROM log),
      r AS (SELECT user_id, island, count(*) FILTER (WHERE NOT success) AS run, count(*) AS n FROM g GROUP BY 1, 2)
      SELECT user_id, CAST(max(run) AS BIGINT) AS longest_streak, CAST(sum(n) AS BIGINT) AS steps FROM r GROUP BY user_id""",
)
def error_streaks(spark, sf):
    """Longest run of failed steps per user, linked over days."""
    events = log(spark, sf).withColumn("failed", ~F.col("success"))
    return O.longest_streak(events, ["user_id"], ["ts", "step"], F.to_date("ts"), "failed")


# fifteen minutes, stretched to the pace of the events
_TTL = 900 * 60


@query(
    "ttl_cache_hits",
    f"""WITH RECURSIVE {LOG}, l AS (SELECT user_id, tool_name, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id, tool_name ORDER BY ts, step) AS n FROM log),
      r AS (SELECT user_id, tool_name, n, sec AS stored, false AS hit FROM l WHERE n = 1
        UNION ALL SELECT l.user_id, l.tool_name, l.n, CASE WHEN l.sec - r.stored < {_TTL} THEN r.stored ELSE l.sec END, l.sec - r.stored < {_TTL}
        FROM r JOIN l ON l.user_id = r.user_id AND l.tool_name = r.tool_name AND l.n = r.n + 1)
      SELECT tool_name, count(*) AS lookups, count(*) FILTER (WHERE hit) AS hits FROM r GROUP BY tool_name""",
)
def ttl_cache_hits(spark, sf):
    events = log(spark, sf).select("user_id", "tool_name", "step", "ts", F.col("ts").cast("timestamp").cast("double").alias("at"))
    looked = O.ttl_hits(events, ["user_id", "tool_name"], ["ts", "step"], F.to_date("ts"), "at", _TTL)
    return looked.groupBy("tool_name").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"))


@query(
    "elapsed_budget",
    f"""WITH {LOG}, r AS (SELECT user_id, sum(elapsed_seconds) OVER (PARTITION BY user_id ORDER BY ts, step) AS used FROM log)
      SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE used <= 300) AS within_budget FROM r GROUP BY user_id""",
)
def elapsed_budget(spark, sf):
    """Steps a user completes before a time budget is used up."""
    events = log(spark, sf).select("user_id", "ts", "step", "elapsed_seconds")
    used = O.running_sum(events, ["user_id"], ["ts", "step"], F.to_date("ts"), "elapsed_seconds", "used")
    return used.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("used") <= 300).alias("within_budget"))


@query(
    "guarded_actions",
    f"""WITH {LOG}, n AS (SELECT tool_name, row_number() OVER (PARTITION BY sample_id, tool_name ORDER BY step) AS nth FROM log),
      b(tool_name, allowed) AS (VALUES {", ".join(f"('{t}', {n})" for t, n in budgets.TOOL_BUDGETS.items())})
      SELECT tool_name, count(*) AS actions, count(*) FILTER (WHERE allowed IS NULL OR nth <= allowed) AS executed FROM n LEFT JOIN b USING (tool_name) GROUP BY tool_name""",
)
def guarded_actions(spark, sf):
    """Actions a per-tool call budget lets through."""
    return budgets.guard(log(spark, sf), ["sample_id"], "step", F.col("slot")).groupBy("tool_name").agg(
        F.count("*").alias("actions"), F.count_if("executed").alias("executed")
    )


@query(
    "recent_steps",
    f"""WITH {LOG} SELECT sample_id, step, tool_name, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY step DESC) AS INT) AS from_end FROM log
        QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY step DESC) <= 5""",
)
def recent_steps(spark, sf):
    return T.last_items(log(spark, sf).select("sample_id", "step", "tool_name"), ["sample_id"], "step", 5)


@query(
    "compact_trace",
    f"""WITH {LOG} SELECT CASE WHEN tool_name = 'agent_planner' THEN 'assistant' ELSE 'tool' END AS role, count(*) AS steps, count(DISTINCT 'query ' || CAST(k AS VARCHAR)) AS queries,
        count(error) AS errors FROM log GROUP BY 1""",
)
def compact_trace(spark, sf):
    events = _with_outputs(spark, sf).withColumn("summary", F.lit("planner step"))
    return T.compact_steps(events).groupBy("role").agg(
        F.count("*").alias("steps"), F.count_distinct("query").alias("queries"), F.count("error").alias("errors")
    )


@query(
    "runtime_stats",
    f"""WITH {LOG}, s AS (SELECT sample_id, arg_max(tool_name, step) = 'agent_planner' AS fallback, bool_or(coalesce(contains(error, 'timed out'), false)) AS timed,
          bool_or(tool_name = 'finish_answer' AND error IS NOT NULL) AS answer FROM log GROUP BY 1)
      SELECT count(*) AS samples, count(*) FILTER (WHERE fallback) AS fallback_finish_count, round(avg(CAST(fallback AS INT)), 4) AS fallback_finish_rate,
        count(*) FILTER (WHERE timed AND answer) AS final_answer_timeout_count FROM s""",
)
def runtime_stats(spark, sf):
    per_sample = log(spark, sf).groupBy("sample_id").agg(
        F.when(F.max_by("tool_name", "step") == "agent_planner", "fallback finish").otherwise("done").alias("final_stop_reason"),
        F.max(F.when(F.contains("error", F.lit("timed out")), "request timed out").otherwise("")).alias("error_text"),
        F.bool_or((F.col("tool_name") == "finish_answer") & F.col("error").isNotNull()).alias("answer_error"),
    )
    return T.runtime_stats(per_sample)


@query(
    "token_usage",
    """SELECT o_orderpriority AS worker, CAST(sum(o_custkey) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey END) AS BIGINT) AS completion_tokens FROM orders GROUP BY 1""",
)
def token_usage(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("worker"),
        F.col("o_custkey").alias("prompt_tokens"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("completion_tokens"),
    )
    return T.token_usage(rows, ["worker"], ["prompt_tokens", "completion_tokens"])


@query(
    "planner_error_types",
    f"""WITH {LOG} SELECT CASE WHEN contains(e, 'invalid_request') OR contains(e, '400') THEN 'invalid_request' WHEN contains(e, 'timeout') OR contains(e, 'timed out') THEN 'timeout'
         WHEN contains(e, 'connection') THEN 'connection_error' ELSE 'planner_error' END AS error_type, count(*) AS n
        FROM (SELECT lower(coalesce(error, 'code ' || CAST(k AS VARCHAR) || '00')) AS e FROM log) GROUP BY 1""",
)
def planner_error_types(spark, sf):
    message = F.coalesce("error", F.concat(F.lit("code "), F.col("k").cast("string"), F.lit("00")))
    return log(spark, sf).groupBy(E.planner_error_type(message).alias("error_type")).agg(F.count("*").alias("n"))
