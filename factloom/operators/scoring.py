"""Final score, verdict and error reasons of an evaluated answer.

Works on flat evaluation columns: ``judge_enabled, judge_score, accuracy,
completeness, factual_consistency, judge_errors, coverage, required_coverage,
core_hit, core_contradicted, point_errors, semantic, claim, entity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: component weights, cap and limits
WEIGHTS = {
    "llm_judge": 0.45,
    "structured_point_coverage": 0.25,
    "semantic_similarity": 0.20,
    "claim_rouge_l": 0.05,
    "technical_entity_match": 0.05,
}
CONTRADICTION_CAP = 0.45
REASONS = {
    "semantic": "语义相似度偏低",
    "claim": "参考答案 claim 覆盖不足",
    "entity": "技术实体覆盖不足或偏离参考答案",
    "no_points": "参考答案未抽取到有效结构化采分点",
    "coverage": "采分点覆盖率不足",
    "contradiction": "核心结论与参考答案矛盾",
    "unsupported": "存在参考答案未支持的关键技术实体",
    "judge": "LLM Judge 综合质量评分偏低",
    "not_correct": "未达到完全正确判定阈值",
}


def components() -> dict[str, Column]:
    return {
        "llm_judge": F.when(F.col("judge_enabled"), F.coalesce("judge_score", F.lit(0.0))),
        "structured_point_coverage": F.col("coverage"),
        "semantic_similarity": F.col("semantic"),
        "claim_rouge_l": F.col("claim"),
        "technical_entity_match": F.col("entity"),
    }


def final_score(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the components that exist; a contradicted core
    conclusion caps it."""
    parts = components()
    total = sum((F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(v, F.lit(0.0)) * weights[k] for k, v in parts.items()), F.lit(0.0))
    mean = F.when(total > 0, value / total).otherwise(F.lit(0.0))
    return F.round(F.when(F.col("core_contradicted"), F.least(mean, F.lit(CONTRADICTION_CAP))).otherwise(mean), 6)


def fully_correct() -> Column:
    at_least = lambda name, v: F.coalesce(F.col(name), F.lit(0)) >= v
    judged = (
        at_least("accuracy", 4)
        & at_least("completeness", 4)
        & at_least("factual_consistency", 0.85)
        & at_least("judge_score", 0.80)
        & (F.coalesce("judge_errors", F.lit(0)) == 0)
    )
    points = (
        ~F.coalesce("core_contradicted", F.lit(False))
        & (F.coalesce("point_errors", F.lit(0)) == 0)
        & (F.col("coverage").isNull() | (F.col("coverage") >= 0.80))
        & (F.col("required_coverage").isNull() | ((F.col("required_coverage") >= 0.80) & F.coalesce("core_hit", F.lit(True))))
    )
    alone = F.coalesce(F.col("coverage") >= 0.90, F.lit(False))
    return points & F.when(F.col("judge_enabled"), judged).otherwise(alone)


def reasons(final: str = "final_score", correct: str = "fully_correct", unsupported: str | None = None) -> Column:
    r = REASONS
    extra = F.col(unsupported) > 0 if unsupported else F.lit(False)
    return F.array_compact(
        F.array(
            F.when(F.col("semantic") < 0.55, r["semantic"]),
            F.when(F.col("claim") < 0.20, r["claim"]),
            F.when(F.col("entity") < 0.20, r["entity"]),
            F.when(F.col("coverage").isNull(), r["no_points"]).when(F.col("coverage") < 0.5, r["coverage"]),
            F.when(F.col("core_contradicted"), r["contradiction"]),
            F.when(extra, r["unsupported"]),
            F.when(F.col("judge_enabled") & (F.coalesce("judge_score", F.lit(0.0)) < 0.5), r["judge"]),
            F.when(~F.col(correct), r["not_correct"]),
        )
    )


def severity(reason_list: Column, final: Column) -> Column:
    return F.when((F.size(reason_list) >= 2) | (final < 0.45), "high").when(F.size(reason_list) >= 1, "medium").otherwise("low")


def evaluate(df: DataFrame, unsupported: str | None = None) -> DataFrame:
    return (
        df.withColumn("final_score", final_score())
        .withColumn("fully_correct", fully_correct())
        .withColumn("reasons", reasons(unsupported=unsupported))
        .withColumn("severity", severity(F.col("reasons"), F.col("final_score")))
    )
