"""Run summaries, comparison, ablation, failures, sample sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import reports as R
from ..operators import selection as X
from ..operators.ordered import top_k
from ..operators.scoring import WEIGHTS
from ..plans import experiments
from . import query
from .base import EVALS, evals, table

# ------------------------------------------------------------------ summary

_MEANS = {
    "final_score": "final_score", "semantic": "semantic_similarity", "claim": "claim_rouge_l", "entity": "technical_entity_match",
}
_JUDGE = ("judge_score", "accuracy", "completeness", "clarity", "usefulness", "factual_consistency")
_SUMMARY_COLUMNS = f"""count(*) AS total, {", ".join(f"round(avg(coalesce({c}, 0.0)), 4) AS avg_{n}" for c, n in _MEANS.items())},
   round(coalesce(avg(coverage), 0.0), 4) AS avg_scoring_point_coverage, round(coalesce(avg(required_coverage), 0.0), 4) AS avg_required_point_coverage,
   count(*) FILTER (WHERE coverage IS NULL) AS coverage_null_count, round(avg(CAST(fully_correct AS INT)), 4) AS fully_correct_rate,
   round(avg(CAST(point_errors > 0 OR judge_errors > 0 AS INT)), 4) AS critical_error_rate,
   round(coalesce(avg(CAST(core_hit AS INT)) FILTER (WHERE required_coverage IS NOT NULL), 0.0), 4) AS core_conclusion_hit_rate,
   {", ".join(f"round(avg({k}) FILTER (WHERE judge_enabled), 4) AS judge_{k}" for k in _JUDGE)}"""
SUMMARY = f"{EVALS}, summary AS (SELECT run, {_SUMMARY_COLUMNS} FROM evals GROUP BY run)"


def _summary(spark, sf):
    return R.summarise(evals(spark, sf))


@query("run_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def run_summary(spark, sf):
    return _summary(spark, sf)


@query(
    "duplicate_accounting",
    f"""WITH {EVALS}, ids AS (SELECT run, CASE WHEN position % 97 = 0 THEN '' ELSE sample_id END AS id, count(*) AS n FROM evals GROUP BY 1, 2)
      SELECT run, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE id <> '') AS unique_samples, count(*) FILTER (WHERE id <> '' AND n > 1) AS duplicate_sample_count,
        CAST(coalesce(sum(n - 1) FILTER (WHERE id <> '' AND n > 1), 0) AS BIGINT) AS duplicate_row_count, CAST(coalesce(sum(n) FILTER (WHERE id = ''), 0) AS BIGINT) AS missing_sample_id_rows FROM ids GROUP BY run""",
)
def duplicate_accounting(spark, sf):
    rows = evals(spark, sf).withColumn("sample_id", F.when(F.col("position") % 97 != 0, F.col("sample_id")))
    return R.sample_counts(rows, "run", "sample_id")


_BUCKET = "CASE WHEN final_score < 0.2 THEN '0.0-0.2' WHEN final_score < 0.4 THEN '0.2-0.4' WHEN final_score < 0.6 THEN '0.4-0.6' WHEN final_score < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END"


@query(
    "score_histogram",
    f"""WITH {EVALS}, b(bucket) AS (VALUES ('0.0-0.2'), ('0.2-0.4'), ('0.4-0.6'), ('0.6-0.8'), ('0.8-1.0')), c AS (SELECT run, {_BUCKET} AS bucket, count(*) AS n FROM evals GROUP BY 1, 2)
      SELECT run, bucket, coalesce(n, 0) AS samples FROM (SELECT DISTINCT run FROM evals) CROSS JOIN b LEFT JOIN c USING (run, bucket)""",
)
def score_histogram(spark, sf):
    return R.histogram(evals(spark, sf), "final_score")


# --------------------------------------------------------------- comparison

_COMPARED = {
    "final_score": "avg_final_score", "llm_judge": "judge_judge_score", "semantic_similarity": "avg_semantic_similarity",
    "scoring_point_coverage": "avg_scoring_point_coverage", "claim_rouge_l": "avg_claim_rouge_l",
    "technical_entity_match": "avg_technical_entity_match", "critical_error_rate": "critical_error_rate",
    "fully_correct_rate": "fully_correct_rate", "accuracy": "judge_accuracy", "completeness": "judge_completeness",
}
_UNPIVOT = " UNION ALL ".join(f"SELECT run, '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM summary" for m, c in _COMPARED.items())
COMPARED = f"""{SUMMARY}, metrics AS ({_UNPIVOT}),
   both_runs AS (SELECT metric, max(value) FILTER (WHERE run = 'agent') AS experiment, max(value) FILTER (WHERE run = 'baseline') AS baseline FROM metrics GROUP BY metric),
   d AS (SELECT *, experiment - baseline AS delta, CASE WHEN baseline <> 0 THEN (experiment - baseline) / baseline * 100 ELSE 0.0 END AS delta_pct,
      CASE WHEN metric IN ('critical_error_rate', 'unsupported_entity_rate') THEN baseline - experiment ELSE experiment - baseline END AS gain FROM both_runs WHERE experiment IS NOT NULL AND baseline IS NOT NULL),
   compared AS (SELECT metric, experiment, baseline, delta, delta_pct, gain > 0.01 * abs(baseline) AS improved, gain < -0.02 * abs(baseline) AS regressed,
      CASE WHEN abs(delta_pct) >= 5.0 THEN 'significant' WHEN abs(delta_pct) >= 1.0 THEN 'marginal' ELSE 'negligible' END AS significance FROM d)"""


def _compared(spark, sf):
    return R.compare_metrics(R.unpivot_metrics(_summary(spark, sf), "run", _COMPARED), "run", "agent", "baseline")


@query(
    "metric_compare",
    f"WITH {COMPARED} SELECT metric, experiment, baseline, round(delta, 6) AS delta, round(delta_pct, 4) AS delta_pct, improved, regressed, significance FROM compared",
)
def metric_compare(spark, sf):
    out = _compared(spark, sf)
    return out.withColumns({"delta": F.round("delta", 6), "delta_pct": F.round("delta_pct", 4)})


_COMPONENTS = {
    "llm_judge": "judge_judge_score", "structured_point_coverage": "avg_scoring_point_coverage",
    "semantic_similarity": "avg_semantic_similarity", "claim_rouge_l": "avg_claim_rouge_l", "technical_entity_match": "avg_technical_entity_match",
}
_PARTS = " UNION ALL ".join(
    f"SELECT run, '{m}' AS metric, {w}::DOUBLE AS weight, coalesce({_COMPONENTS[m]}, 0.0) AS score, avg_final_score AS fin FROM summary" for m, w in WEIGHTS.items()
)


@query(
    "ablation",
    f"""WITH {SUMMARY}, p AS ({_PARTS}), a AS (SELECT * FROM p WHERE run = 'agent'), b AS (SELECT * FROM p WHERE run = 'baseline')
      SELECT metric, a.weight AS weight, a.score AS score, round(a.score * a.weight, 6) AS weighted_score, round(b.score * b.weight, 6) AS baseline_weighted_score,
        round(CASE WHEN a.fin > 0 THEN a.score * a.weight / a.fin * 100 ELSE 0.0 END, 4) AS contribution_pct, round(a.score * a.weight - b.score * b.weight, 6) AS delta FROM a JOIN b USING (metric)""",
)
def ablation(spark, sf):
    out = R.ablation(_summary(spark, sf), "run", "agent", "baseline", {**_COMPONENTS, "final_score": "avg_final_score"})
    six = ("weighted_score", "baseline_weighted_score", "delta")
    return out.withColumns({**{c: F.round(c, 6) for c in six}, "contribution_pct": F.round("contribution_pct", 4)})


_LATEST = """latest AS (SELECT * FROM evals QUALIFY row_number() OVER (PARTITION BY run, sample_id ORDER BY position DESC) = 1)"""
_METRICS = {"llm_judge": "judge_score", "semantic_similarity": "semantic", "claim_rouge_l": "claim", "technical_entity_match": "entity"}
DELTAS = f"""{EVALS}, {_LATEST}, deltas AS (SELECT a.sample_id, b.final_score AS baseline, a.final_score AS agent, round(a.final_score - b.final_score, 6) AS delta,
   {", ".join(f"round(a.{c} - b.{c}, 4) AS {m}_delta" for m, c in _METRICS.items())}
   FROM (SELECT * FROM latest WHERE run = 'agent') a JOIN (SELECT * FROM latest WHERE run = 'baseline') b USING (sample_id))"""


def _side(spark, sf, run):
    rows = evals(spark, sf).filter(F.col("run") == run)
    return dedup.keep_last(rows.select("sample_id", "position", "final_score", *_METRICS.values()), "sample_id", "position")


def _deltas(spark, sf):
    return R.sample_deltas(_side(spark, sf, "baseline"), _side(spark, sf, "agent"), "sample_id", _METRICS)


@query("sample_deltas", f"WITH {DELTAS} SELECT * FROM deltas")
def sample_deltas(spark, sf):
    return _deltas(spark, sf)


@query(
    "delta_summary",
    f"""WITH {DELTAS} SELECT count(*) AS shared_samples, round(avg(delta), 4) AS average_delta, {", ".join(f"round(avg({m}_delta), 4) AS {m}_delta" for m in _METRICS)},
        count(*) FILTER (WHERE delta > 0) AS improved, count(*) FILTER (WHERE delta < 0) AS regressed, round(count(*) FILTER (WHERE delta > 0) / CAST(count(*) AS DOUBLE), 4) AS win_rate FROM deltas""",
)
def delta_summary(spark, sf):
    return R.delta_summary(_deltas(spark, sf))


@query(
    "win_rate",
    f"""WITH {DELTAS} SELECT round(count(*) FILTER (WHERE delta > 0) / CAST(count(*) AS DOUBLE), 4) AS win_rate FROM deltas""",
)
def win_rate(spark, sf):
    return R.win_rate(_deltas(spark, sf))


@query(
    "top_changes",
    f"""WITH {DELTAS} (SELECT 'improved' AS side, sample_id, delta FROM deltas WHERE delta > 0 ORDER BY delta DESC, sample_id LIMIT 30)
      UNION ALL (SELECT 'regressed', sample_id, delta FROM deltas WHERE delta < 0 ORDER BY delta, sample_id LIMIT 30)""",
)
def top_changes(spark, sf):
    d = _deltas(spark, sf).select("sample_id", "delta")
    up = d.filter("delta > 0").orderBy(F.desc("delta"), "sample_id").limit(30).select(F.lit("improved").alias("side"), "sample_id", "delta")
    down = d.filter("delta < 0").orderBy("delta", "sample_id").limit(30).select(F.lit("regressed").alias("side"), "sample_id", "delta")
    return up.unionByName(down)


@query(
    "bottom_samples",
    f"WITH {EVALS} SELECT run, sample_id, position, final_score FROM evals QUALIFY row_number() OVER (PARTITION BY run ORDER BY final_score, position) <= 30",
)
def bottom_samples(spark, sf):
    rows = evals(spark, sf).select("run", "sample_id", "position", "final_score")
    return top_k(rows, ["run"], [F.col("final_score"), F.col("position")], 30).drop("rank")


@query(
    "verification",
    f"""WITH {COMPARED} SELECT count(*) FILTER (WHERE improved) AS improvements, count(*) FILTER (WHERE regressed) AS regressions,
        count(*) FILTER (WHERE regressed AND significance = 'significant') = 0 AS comparison_passed,
        (SELECT round(avg(CAST(final_score < 0.2 AS INT)), 6) FROM evals WHERE run = 'agent') AS critical_failure_rate,
        count(*) FILTER (WHERE regressed AND significance = 'significant') = 0 AND (SELECT avg(CAST(final_score < 0.2 AS INT)) FROM evals WHERE run = 'agent') <= 0.5 AS passed FROM compared""",
)
def verification(spark, sf):
    return experiments.verify(evals(spark, sf), "run", "agent", "baseline", _COMPARED)


# ----------------------------------------------------------------- failures

_FLAGS = {
    "low_completeness": "judge_enabled AND completeness <= 2",
    "contradictions": "judge_error_text IS NOT NULL",
    "low_factual_consistency": "judge_enabled AND factual_consistency < 0.5",
    "low_coverage": "coalesce(coverage, 1.0) < 0.3",
    "timeout_errors": "coalesce(contains(error_text, 'timed out'), false)",
}


@query(
    "failure_categories",
    f"""WITH {EVALS}, failed AS (SELECT *, {" + ".join(f"CAST({c} AS INT)" for c in _FLAGS.values())} AS tags FROM evals WHERE final_score < 0.4),
      t AS (SELECT run, count(*) AS total FROM failed GROUP BY run),
      c AS ({" UNION ALL ".join(f"SELECT run, '{n}' AS category, count(*) AS samples, avg(final_score) AS a FROM failed WHERE {c} GROUP BY run" for n, c in _FLAGS.items())}
         UNION ALL SELECT run, 'other', count(*), avg(final_score) FROM failed WHERE tags = 0 GROUP BY run)
      SELECT run, category, samples, round(samples / CAST(total AS DOUBLE) * 100, 4) AS percentage, round(a, 6) AS avg_score FROM c JOIN t USING (run) WHERE samples >= 3""",
)
def failure_categories(spark, sf):
    return R.failure_categories(evals(spark, sf))


@query(
    "failure_rates",
    f"""WITH {EVALS} SELECT run, count(*) AS total_samples, count(*) FILTER (WHERE final_score < 0.4) AS failed_samples,
        round(avg(CAST(final_score < 0.4 AS INT)), 6) AS failure_rate, round(avg(CAST(final_score < 0.2 AS INT)), 6) AS critical_failure_rate FROM evals GROUP BY run""",
)
def failure_rates(spark, sf):
    return R.failure_rates(evals(spark, sf))


@query(
    "failure_patterns",
    f"""WITH {EVALS}, e AS (SELECT run, substr(error_text, 1, 50) AS value, count(*) AS n, min(position) AS at_pos FROM evals WHERE final_score < 0.4 AND error_text IS NOT NULL GROUP BY 1, 2)
      SELECT run, value, n, CAST(row_number() OVER (PARTITION BY run ORDER BY n DESC, at_pos) AS INT) AS rank FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC, at_pos) <= 3""",
)
def failure_patterns(spark, sf):
    failed = evals(spark, sf).filter(F.col("final_score") < R.FAILED_BELOW)
    return R.common_values(failed, "run", F.col("errors"), "position", 3, 50)


@query(
    "weak_dimensions",
    f"""WITH {EVALS}, u AS (SELECT run, unnest(['accuracy', 'completeness', 'clarity', 'usefulness']) AS dimension, unnest([accuracy, completeness, clarity, usefulness]) AS v FROM evals WHERE final_score < 0.4)
      SELECT run, dimension, round(avg(v), 2) AS avg_score, count(*) AS n FROM u GROUP BY 1, 2""",
)
def weak_dimensions(spark, sf):
    return R.weak_dimensions(evals(spark, sf))


# --------------------------------------------------------------- sample sets


@query(
    "sample_set_diff",
    f"""WITH {EVALS}, a AS (SELECT DISTINCT sample_id FROM evals WHERE run = 'agent' AND final_score >= 0.5), b AS (SELECT DISTINCT sample_id FROM evals WHERE run = 'baseline' AND final_score >= 0.5)
      SELECT sample_id, 'agent' AS missing_in FROM b WHERE sample_id NOT IN (SELECT sample_id FROM a) UNION ALL
      SELECT sample_id, 'baseline' FROM a WHERE sample_id NOT IN (SELECT sample_id FROM b)""",
)
def sample_set_diff(spark, sf):
    good = evals(spark, sf).filter("final_score >= 0.5")
    return R.sample_set_diff(good.filter("run = 'agent'"), good.filter("run = 'baseline'"), "sample_id")


@query(
    "resume_antijoin",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def resume_antijoin(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return X.remaining(table(spark, sf, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query(
    "ordered_id_filter",
    """WITH ids AS (SELECT o_custkey AS c_custkey, min(o_orderkey) AS list_position FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
       SELECT c_custkey, c_name, list_position FROM customer JOIN ids USING (c_custkey)""",
)
def ordered_id_filter(spark, sf):
    ids = table(spark, sf, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("pos"))
    items = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_custkey").alias("seen"))
    return X.by_id_list(items, "c_custkey", ids, "pos", "seen").select("c_custkey", "c_name", "list_position")


@query(
    "retry_failed",
    f"""WITH {EVALS}, {_LATEST} SELECT DISTINCT p_partkey FROM part JOIN latest ON sample_id = 'P' || CAST(p_partkey AS VARCHAR) WHERE run = 'agent' AND error_text IS NOT NULL""",
)
def retry_failed(spark, sf):
    """Parts whose latest agent row failed; an empty list selects nothing."""
    rows = evals(spark, sf).filter("run = 'agent'").select("sample_id", "position", "errors")
    last = dedup.keep_last(rows, "sample_id", "position")
    failed = last.filter(X.hard_failed(F.lit("answer"), F.col("errors"))).select("sample_id")
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sample_id"))
    return parts.join(failed, "sample_id", "left_semi").select("p_partkey")


@query(
    "eval_repair",
    f"""WITH {EVALS}, {_LATEST} SELECT o.sample_id, CASE WHEN NOT o.judge_enabled AND n.sample_id IS NOT NULL THEN n.final_score ELSE o.final_score END AS final_score,
        CASE WHEN NOT o.judge_enabled AND n.sample_id IS NOT NULL THEN n.judge_enabled ELSE o.judge_enabled END AS judge_enabled
        FROM (SELECT * FROM latest WHERE run = 'agent') o LEFT JOIN (SELECT * FROM latest WHERE run = 'other') n USING (sample_id)""",
)
def eval_repair(spark, sf):
    def latest(run):
        rows = evals(spark, sf).filter(F.col("run") == run).select("sample_id", "position", "final_score", "judge_enabled")
        return dedup.keep_last(rows, "sample_id", "position").select("sample_id", "final_score", "judge_enabled")

    return X.repaired(latest("agent"), latest("other"), "sample_id", ~F.col("judge_enabled"))


@query("seeded_sample", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '|42') AS ticket FROM documents ORDER BY 2, 1 LIMIT 20")
def seeded_sample(spark, sf):
    return X.seeded_sample(table(spark, sf, "documents"), "doc_id", 42, 20)


@query(
    "generation_outcomes",
    """WITH a AS (SELECT role, CASE WHEN length(text) % 7 = 0 THEN '  ' WHEN length(text) % 11 = 0 THEN '[ERROR] ' || text ELSE text END AS answer FROM conversations)
       SELECT role, count(*) AS total, count(*) FILTER (WHERE trim(answer) <> '' AND NOT contains(answer, '[ERROR]') AND NOT contains(answer, '生成失败')) AS generated FROM a GROUP BY role""",
)
def generation_outcomes(spark, sf):
    n = F.length("text")
    answer = F.when(n % 7 == 0, "  ").when(n % 11 == 0, F.concat(F.lit("[ERROR] "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("total"), F.count_if(~X.generation_failed(answer)).alias("generated")
    )
