"""Verify an experiment against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports as R


def verify(rows: DataFrame, run: str, experiment: str, baseline: str, metrics: dict[str, str]) -> DataFrame:
    """One row: comparison counts, critical failure rate and the verdict."""
    compared = R.compare_metrics(R.unpivot_metrics(R.summarise(rows, run), run, metrics), run, experiment, baseline)
    critical = R.failure_rates(rows.filter(F.col(run) == experiment), run).select("critical_failure_rate").scalar()
    return R.comparison_passed(compared).select(
        "improvements",
        "regressions",
        F.col("passed").alias("comparison_passed"),
        critical.alias("critical_failure_rate"),
        R.verdict(F.col("passed"), critical).alias("passed"),
    )


def full_report(rows: DataFrame, run: str, experiment: str, baseline: str, metrics: dict[str, str], components: dict[str, str]) -> dict[str, DataFrame]:
    """The frames of a verification report by name."""
    summary = R.summarise(rows, run)
    mine = rows.filter(F.col(run) == experiment)
    return {
        "summary": summary,
        "comparison": R.compare_metrics(R.unpivot_metrics(summary, run, metrics), run, experiment, baseline),
        "ablation": R.ablation(summary, run, experiment, baseline, components),
        "failures": R.failure_categories(mine, run),
        "failure_rates": R.failure_rates(mine, run),
        "histogram": R.histogram(mine, "final_score", run),
        "verdict": verify(rows, run, experiment, baseline, metrics),
    }
