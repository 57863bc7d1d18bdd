"""Page reads by several backends, and checks of the calls that asked for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def acceptable(score: Column, chars: Column, min_score: float, min_chars: int) -> Column:
    """Whether extracted content is good and long enough; content without a score or a length is not."""
    return F.coalesce((chars >= min_chars) & (score >= min_score), F.lit(False))


def read_cascade(
    attempts: DataFrame, key: str, order: tuple[str, ...], backend: str = "backend", score: str = "quality_score", chars: str = "clean_chars",
    error: str = "error", min_score: float = 0.0, min_chars: int = 1,
) -> DataFrame:
    """``attempts`` with ``outcome`` and ``reason``: of the backends in ``order`` the first with acceptable content wins.

    won, not_reached (after the winner), failed (its error), empty (no content), too_short, low_score, unlisted
    """
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(backend))
    fine = acceptable(F.col(score), F.col(chars), min_score, min_chars) & F.col(error).isNull() & (rank > 0)
    winner = attempts.where(fine).groupBy(key).agg(F.min(rank).alias("_winner"))
    told = attempts.join(winner, key, "left").withColumn("_rank", rank)
    outcome = (
        F.when(F.col("_rank") == 0, "unlisted")
        .when(F.col("_rank") == F.col("_winner"), "won")
        .when(F.col("_rank") > F.col("_winner"), "not_reached")
        .when(F.col(error).isNotNull(), "failed")
        .when(F.coalesce(F.col(chars), F.lit(0)) == 0, "empty")
        .when(F.col(chars) < min_chars, "too_short")
        .otherwise("low_score")
    )
    told = told.withColumn("outcome", outcome)
    reason = F.when(F.col("outcome") == "failed", F.concat_ws(": ", backend, error)).when(
        F.col("outcome").isin("empty", "too_short", "low_score"), F.concat_ws(": ", backend, "outcome")
    )
    return told.withColumn("reason", reason).drop("_winner", "_rank")


def fetch_summary(told: DataFrame, backend: str = "backend", score: str = "quality_score", chars: str = "clean_chars") -> DataFrame:
    """Per backend: attempts, wins, failures, and the means of length and score over all its attempts."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    mean = lambda c, digits: F.round(F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")), digits)
    return told.groupBy(backend).agg(
        F.count("*").alias("fetches"), n("won").alias("wins"), n("failed").alias("failures"), mean(chars, 0).alias("avg_chars"), mean(score, 4).alias("avg_quality")
    )


#: What an argument of each type may be in JSON; a truth value counts as a whole number.
_KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|BOOLEAN|DECIMAL\([0-9]+,0\))$", "boolean": r"^BOOLEAN$"}


def argument_problem(tool: Column, args: Column, specs: dict[str, list[tuple[str, str, bool]]], enabled: tuple[str, ...] | None = None) -> Column:
    """Why a call's JSON arguments cannot be used, else NULL.

    ``specs`` has (argument, type, required) of each tool, in the order in which they are checked; ``enabled`` names the tools that may run
    (default: all).  An argument that is null counts as given, but has no type.
    """
    parsed = F.try_parse_json(args)
    out = F.lit("unknown tool")
    for name, fields in specs.items():
        problem = F.lit(None).cast("string")
        for key, kind, required in reversed(fields):
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            shape = F.schema_of_variant(value)
            wrong = value.isNotNull() & (shape != "VOID") & ~F.rlike(shape, F.lit(_KINDS[kind]))
            problem = F.when(wrong, f"{key} must be of type {kind}").otherwise(problem)
            if required:
                problem = F.when(value.isNull(), f"missing required argument: {key}").otherwise(problem)
        is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
        own = F.when(~F.coalesce(is_object, F.lit(False)), "arguments must be an object").otherwise(problem)
        if enabled is not None and name not in enabled:
            own = F.lit("tool is disabled")
        out = F.when(tool == name, own).otherwise(out)
    return out
