"""Prediction and evaluation rows from different writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.selection import hard_failed

EVAL_KEYS = (
    "semantic_similarity", "llm_judge", "scoring_points", "final_score", "claim_rouge_l", "technical_entity_match",
)


def normalise(df: DataFrame) -> DataFrame:
    """One name per field: ``sample_id`` or ``post_id``, ``answer`` or
    ``generated_answer``; empty strings count as missing."""

    def first(*names: str):
        have = [T.blank_to_null(F.col(n).cast("string")) for n in names if n in df.columns]
        return F.coalesce(*have, F.lit(""))

    rest = [c for c in df.columns if c not in ("sample_id", "post_id", "answer", "generated_answer")]
    return df.select(first("sample_id", "post_id").alias("sample_id"), first("answer", "generated_answer").alias("answer"), *rest)


def has_evaluation(df: DataFrame):
    """All six evaluation fields are present."""
    out = F.lit(True)
    for key in EVAL_KEYS:
        out = out & (F.col(key).isNotNull() if key in df.columns else F.lit(False))
    return out


def failed_row(message):
    """Default evaluation of a row that could not be evaluated."""
    return F.struct(
        F.lit(0.0).alias("final_score"),
        F.lit(False).alias("fully_correct"),
        F.lit(None).cast("double").alias("coverage"),
        F.lit(False).alias("judge_enabled"),
        F.array(message).alias("errors"),
    )


def failed_ids(df: DataFrame) -> DataFrame:
    return df.filter(hard_failed(F.col("answer"), F.col("errors"))).select("sample_id")
