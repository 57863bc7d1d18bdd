"""Run summaries, comparison, ablation and failure analysis.

Everything is a grouped aggregation over evaluation rows; runs are a column, so
one pass summarises any number of runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import top_k
from .scoring import WEIGHTS

JUDGE_KEYS = ("judge_score", "accuracy", "completeness", "clarity", "usefulness", "average_score", "factual_consistency")
AVERAGES = {
    "final_score": "final_score",
    "semantic": "semantic_similarity",
    "claim": "claim_rouge_l",
    "entity": "technical_entity_match",
    "entity_precision": "technical_entity_precision",
    "entity_recall": "technical_entity_recall",
    "entity_f_beta": "technical_entity_f_beta",
    "unsupported_rate": "unsupported_entity_rate",
}


def mean(col: Column) -> Column:
    """Average of the present values, 0 without any."""
    return F.coalesce(F.avg(col), F.lit(0.0))


def rate(condition: Column) -> Column:
    return mean(F.when(condition, 1.0).when(~condition | condition.isNull(), 0.0))


def summarise(rows: DataFrame, run: str = "run") -> DataFrame:
    """One row per run: totals, averages, quality rates, judge averages.

    Judge averages stay NULL for a run without enabled judge rows.
    """
    have = [(c, n) for c, n in AVERAGES.items() if c in rows.columns]
    judged = [k for k in JUDGE_KEYS if k in rows.columns]
    errors = (F.coalesce("point_errors", F.lit(0)) > 0) | (F.coalesce("judge_errors", F.lit(0)) > 0)
    core = F.when(F.col("required_coverage").isNotNull(), F.coalesce(F.col("core_hit"), F.lit(False)).cast("double"))
    return rows.groupBy(run).agg(
        F.count("*").alias("total"),
        *[F.round(mean(F.coalesce(F.col(c), F.lit(0.0))), 4).alias(f"avg_{n}") for c, n in have],
        F.round(mean(F.col("coverage")), 4).alias("avg_scoring_point_coverage"),
        F.round(mean(F.col("required_coverage")), 4).alias("avg_required_point_coverage"),
        F.count_if(F.col("coverage").isNull()).alias("coverage_null_count"),
        F.round(rate(F.col("fully_correct")), 4).alias("fully_correct_rate"),
        F.round(rate(errors), 4).alias("critical_error_rate"),
        F.round(mean(core), 4).alias("core_conclusion_hit_rate"),
        *[F.round(F.avg(F.when(F.col("judge_enabled"), F.col(k))), 4).alias(f"judge_{k}") for k in judged],
    )


def sample_counts(rows: DataFrame, run: str, sample: str) -> DataFrame:
    """Rows, unique ids, duplicated ids, surplus rows, rows without id."""
    keyed = rows.select(run, F.coalesce(F.col(sample).cast("string"), F.lit("")).alias("_id"))
    per_id = keyed.groupBy(run, "_id").agg(F.count("*").alias("_n"))
    known = F.col("_id") != ""
    twice = known & (F.col("_n") > 1)
    return per_id.groupBy(run).agg(
        F.sum("_n").alias("rows"),
        F.count_if(known).alias("unique_samples"),
        F.count_if(twice).alias("duplicate_sample_count"),
        F.sum(F.when(twice, F.col("_n") - 1).otherwise(0)).alias("duplicate_row_count"),
        F.sum(F.when(known, 0).otherwise(F.col("_n"))).alias("missing_sample_id_rows"),
    )


# fixed values: half-open score buckets
BUCKETS = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")


def histogram(rows: DataFrame, score: str, run: str = "run") -> DataFrame:
    """Rows per bucket and run; empty buckets are kept."""
    value = F.coalesce(F.col(score), F.lit(0.0))
    edges = [0.2, 0.4, 0.6, 0.8]
    inside = []
    for i, name in enumerate(BUCKETS):
        low = value >= edges[i - 1] if i else F.lit(True)
        high = value < edges[i] if i < len(edges) else F.lit(True)
        inside.append(F.struct(F.lit(name).alias("bucket"), F.count_if(low & high).alias("samples")))
    return rows.groupBy(run).agg(F.array(*inside).alias("_h")).select(run, F.inline("_h"))


# ------------------------------------------------------------- comparison

LOWER_IS_BETTER = ("critical_error_rate", "unsupported_entity_rate")


def unpivot_metrics(summary: DataFrame, run: str, metrics: dict[str, str]) -> DataFrame:
    """(run, metric, value) rows from a summary frame."""
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in metrics.items()])
    return summary.select(run, F.inline(entries))


def compare_metrics(
    metrics: DataFrame, run: str, experiment: str, baseline: str, improvement: float = 0.01, regression: float = 0.02
) -> DataFrame:
    """Delta, percentage, verdict and significance per metric of two runs."""
    side = lambda name, out: F.max(F.when(F.col(run) == name, F.col("value"))).alias(out)
    paired = (
        metrics.filter(F.col(run).isin(experiment, baseline))
        .groupBy("metric")
        .agg(side(experiment, "experiment"), side(baseline, "baseline"))
        .filter(F.col("experiment").isNotNull() & F.col("baseline").isNotNull())
    )
    base, delta = F.col("baseline"), F.col("experiment") - F.col("baseline")
    gain = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -delta).otherwise(delta)
    pct = F.when(base != 0, delta / base * 100).otherwise(0.0)
    return (
        paired.withColumn("delta", delta)
        .withColumn("delta_pct", pct)
        .withColumn("improved", gain > improvement * F.abs(base))
        .withColumn("regressed", gain < -regression * F.abs(base))
        .withColumn(
            "significance",
            F.when(F.abs("delta_pct") >= 5.0, "significant").when(F.abs("delta_pct") >= 1.0, "marginal").otherwise("negligible"),
        )
    )


def comparison_passed(compared: DataFrame) -> DataFrame:
    bad = F.col("regressed") & (F.col("significance") == "significant")
    return compared.agg(
        F.count_if("improved").alias("improvements"),
        F.count_if("regressed").alias("regressions"),
        (F.count_if(bad) == 0).alias("passed"),
    )


def ablation(summary: DataFrame, run: str, experiment: str, baseline: str | None, columns: dict[str, str], weights=WEIGHTS) -> DataFrame:
    """Weighted contribution of every component, with deltas to a baseline."""
    metrics = unpivot_metrics(summary, run, {k: columns[k] for k in weights})
    final = unpivot_metrics(summary, run, {"final_score": columns["final_score"]}).select(
        F.col(run), F.col("value").alias("_final")
    )
    weight = reduce(lambda a, kv: a.when(F.col("metric") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0))
    scored = (
        metrics.join(final, run)
        .withColumn("weight", weight)
        .withColumn("score", F.coalesce("value", F.lit(0.0)))
        .withColumn("weighted_score", F.col("score") * F.col("weight"))
    )
    pick = lambda name, col: F.max(F.when(F.col(run) == name, F.col(col)))
    wide = scored.groupBy("metric", "weight").agg(
        pick(experiment, "score").alias("score"),
        pick(experiment, "weighted_score").alias("weighted_score"),
        pick(experiment, "_final").alias("_final"),
        (pick(baseline, "weighted_score") if baseline else F.lit(None).cast("double")).alias("baseline_weighted_score"),
    )
    pct = F.when(F.col("_final") > 0, F.col("weighted_score") / F.col("_final") * 100).otherwise(0.0)
    return (
        wide.withColumn("contribution_pct", pct)
        .withColumn("delta", F.col("weighted_score") - F.col("baseline_weighted_score"))
        .drop("_final")
    )


METRICS = ("llm_judge", "semantic_similarity", "claim_rouge_l", "technical_entity_match")


def sample_deltas(baseline: DataFrame, agent: DataFrame, sample: str, metrics: dict[str, str]) -> DataFrame:
    """Per-sample differences over the shared samples.  Both sides hold one row
    per sample (see :mod:`factloom.operators.dedup`)."""
    cols = {"final_score": "final_score", **metrics}
    pick = lambda df, side: df.select(sample, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{side}_{n}") for n, c in cols.items()])
    both = pick(baseline, "b").join(pick(agent, "a"), sample)
    return both.select(
        sample,
        F.col("b_final_score").alias("baseline"),
        F.col("a_final_score").alias("agent"),
        F.round(F.col("a_final_score") - F.col("b_final_score"), 6).alias("delta"),
        *[F.round(F.col(f"a_{n}") - F.col(f"b_{n}"), 4).alias(f"{n}_delta") for n in metrics],
    )


def delta_summary(deltas: DataFrame) -> DataFrame:
    extra = [c for c in deltas.columns if c.endswith("_delta")]
    return deltas.agg(
        F.count("*").alias("shared_samples"),
        F.round(mean(F.col("delta")), 4).alias("average_delta"),
        *[F.round(mean(F.col(c)), 4).alias(c) for c in extra],
        F.count_if(F.col("delta") > 0).alias("improved"),
        F.count_if(F.col("delta") < 0).alias("regressed"),
        F.round(rate(F.col("delta") > 0), 4).alias("win_rate"),
    )


def win_rate(deltas: DataFrame, cap: int | None = None) -> DataFrame:
    """Share of improved samples; ``cap`` reproduces reports that truncate both
    lists before counting."""
    up, down = F.count_if(F.col("delta") > 0), F.count_if(F.col("delta") < 0)
    if cap:
        up, down = F.least(up, F.lit(cap)), F.least(down, F.lit(cap))
    total = F.greatest(F.count("*"), up + down)
    return deltas.agg(F.round(F.when(total > 0, up / total).otherwise(0.0), 4).alias("win_rate"))


def sample_set_diff(left: DataFrame, right: DataFrame, sample: str) -> DataFrame:
    """Ids present on one side only."""
    a, b = left.select(sample).distinct(), right.select(sample).distinct()
    return (
        b.join(a, sample, "left_anti").withColumn("missing_in", F.lit("agent"))
        .unionByName(a.join(b, sample, "left_anti").withColumn("missing_in", F.lit("baseline")))
    )


# --------------------------------------------------------------- failures

CATEGORIES = ("low_completeness", "contradictions", "low_factual_consistency", "low_coverage", "timeout_errors")
FAILED_BELOW, CRITICAL_BELOW, MIN_SIZE = 0.4, 0.2, 3


def failure_flags(parity: bool = False) -> dict[str, Column]:
    """Overlapping predicates.  Judge ratings count only where a judge ran,
    unless ``parity`` asks for the placeholder zeros to count as ratings."""
    judged = F.lit(True) if parity else F.col("judge_enabled")
    low_errors = F.transform(F.coalesce("judge_error_list", F.array().cast("array<string>")), F.lower)
    run_errors = F.transform(F.coalesce("errors", F.array().cast("array<string>")), F.lower)
    return {
        "low_completeness": judged & (F.coalesce("completeness", F.lit(5)) <= 2),
        "contradictions": F.exists(low_errors, lambda e: F.contains(e, F.lit("contradict"))),
        "low_factual_consistency": judged & (F.coalesce("factual_consistency", F.lit(1.0)) < 0.5),
        "low_coverage": F.coalesce("coverage", F.lit(1.0)) < 0.3,
        "timeout_errors": F.exists(run_errors, lambda e: F.contains(e, F.lit("timeout")) | F.contains(e, F.lit("timed out"))),
    }


def failure_categories(rows: DataFrame, run: str = "run", min_size: int = MIN_SIZE, parity: bool = False) -> DataFrame:
    """Categories of failed samples with size, share and mean score.

    A category is reported from ``min_size`` samples on; ``other`` holds the
    failed samples in no *reported* category.  The five flags of a sample are
    kept as one set, so category sizes and the rest come from counts per set.
    """
    flags = failure_flags(parity)
    failed = rows.filter(F.coalesce("final_score", F.lit(0.0)) < FAILED_BELOW)
    tagged = failed.select(
        run, "final_score", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()])).alias("tags")
    )
    sets = tagged.groupBy(run, "tags").agg(F.count("*").alias("n"), F.sum("final_score").alias("s"))
    single = sets.select(run, F.explode("tags").alias("category"), "n", "s")
    sized = (
        single.groupBy(run, "category")
        .agg(F.sum("n").alias("samples"), F.sum("s").alias("s"))
        .filter(F.col("samples") >= min_size)
    )
    reported = sized.groupBy(run).agg(F.collect_set("category").alias("_reported"))
    rest = (
        sets.join(reported, run, "left")
        .filter(~F.arrays_overlap("tags", F.coalesce("_reported", F.array().cast("array<string>"))))
        .groupBy(run)
        .agg(F.sum("n").alias("samples"), F.sum("s").alias("s"))
        .filter(F.col("samples") >= min_size)
        .select(run, F.lit("other").alias("category"), "samples", "s")
    )
    totals = sets.groupBy(run).agg(F.sum("n").alias("_failed"))
    return (
        sized.unionByName(rest)
        .join(totals, run)
        .select(
            run,
            "category",
            "samples",
            F.round(F.col("samples") / F.col("_failed") * 100, 4).alias("percentage"),
            F.round(F.col("s") / F.col("samples"), 6).alias("avg_score"),
        )
    )


def failure_rates(rows: DataFrame, run: str = "run") -> DataFrame:
    score = F.coalesce("final_score", F.lit(0.0))
    return rows.groupBy(run).agg(
        F.count("*").alias("total_samples"),
        F.count_if(score < FAILED_BELOW).alias("failed_samples"),
        F.round(rate(score < FAILED_BELOW), 6).alias("failure_rate"),
        F.round(rate(score < CRITICAL_BELOW), 6).alias("critical_failure_rate"),
    )


def common_values(rows: DataFrame, run: str, values: Column, position: str, k: int, chars: int | None = None) -> DataFrame:
    """Most frequent array items; ties go to the item seen first."""
    item = F.substring("_v", 1, chars) if chars else F.col("_v")
    counted = (
        rows.select(run, position, F.posexplode(values).alias("_i", "_v"))
        .select(run, item.alias("value"), F.struct(position, "_i").alias("_at"))
        .groupBy(run, "value")
        .agg(F.count("*").alias("n"), F.min("_at").alias("_at"))
    )
    return top_k(counted, [run], [F.desc("n"), F.col("_at")], k).drop("_at")


def missed_points(rows: DataFrame, points: str, position: str, run: str = "run", k: int = 5, most: int | None = 8) -> DataFrame:
    """The points that failed samples of a run missed most often; of a sample the first ``most`` count (None: all)."""
    failed = rows.filter(F.coalesce("final_score", F.lit(0.0)) < FAILED_BELOW)
    items = F.coalesce(F.col(points), F.array().cast("array<string>"))
    return common_values(failed, run, F.slice(items, 1, most) if most else items, position, k)


def weak_dimensions(rows: DataFrame, run: str = "run") -> DataFrame:
    """Mean judge rating per dimension over failed samples, weakest first."""
    names = ("accuracy", "completeness", "clarity", "usefulness")
    failed = rows.filter(F.coalesce("final_score", F.lit(0.0)) < FAILED_BELOW)
    entries = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).cast("double").alias("v")) for n in names])
    return (
        failed.select(run, F.inline(entries))
        .filter(F.col("v").isNotNull())
        .groupBy(run, "dimension")
        .agg(F.round(F.avg("v"), 2).alias("avg_score"), F.count("*").alias("n"))
    )


def verdict(passed: Column, critical_rate: Column) -> Column:
    return F.coalesce(passed, F.lit(True)) & ~(F.coalesce(critical_rate, F.lit(0.0)) > 0.5)
