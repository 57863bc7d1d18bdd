"""Evaluate answers: every metric, the final score and the reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicons
from ..operators import matching as M
from ..operators import scoring as S
from ..operators.lexical import token_idf
from ..operators.predictions import Joined, join_predictions


def corpus_idf(pairs: DataFrame, lex: Lexicons = DEFAULT) -> DataFrame:
    """Entity frequencies over questions and references of the whole dataset."""
    from ..functions import entities as E

    text = pairs.select("sample_id", E.fold(F.concat_ws("\n", "question", "reference")).alias("_t"))
    return token_idf(text, "sample_id", E.candidates(F.col("_t"), lex))


def evaluate(pairs: DataFrame, lex: Lexicons = DEFAULT, judged: DataFrame | None = None, vectors: tuple[str, str] | None = None) -> DataFrame:
    """``pairs``: sample_id, question, reference, prediction.

    ``judged`` may bring parsed judge columns per sample; without it the judge
    counts as disabled and the other weights are scaled up.
    """
    points = M.scoring_points(pairs, lex=lex)
    coverage = M.point_coverage(M.match_points(points, pairs, lex))
    # aliases of the points support entities of the answer
    aliases = points.groupBy("sample_id").agg(
        F.concat_ws(" ", F.flatten(F.collect_list(F.concat("aliases", F.array("text"))))).alias("aliases")
    )
    supported = pairs.join(aliases, "sample_id", "left")
    entities = M.entity_match(M.entity_rows(supported, lex, corpus_idf(pairs, lex)), pairs)
    claims = M.claim_score(M.claim_rouge(pairs, lex=lex), pairs)
    similar = M.similarity(pairs, vectors).select("sample_id", F.col("semantic_similarity").alias("semantic"))
    rows = (
        similar.join(claims.select("sample_id", F.col("claim_rouge_l").alias("claim")), "sample_id")
        .join(entities.select("sample_id", F.col("score").alias("entity"), "unsupported_entity_rate"), "sample_id")
        .join(coverage, "sample_id", "left")
        .withColumnRenamed("core_conclusion_hit", "core_hit")
        .withColumn("core_contradicted", F.coalesce("core_contradicted", F.lit(False)))
        .withColumn("point_errors", F.col("core_contradicted").cast("int"))
        .withColumn("unsupported", (F.col("unsupported_entity_rate") > 0).cast("int"))
    )
    if judged is not None:
        rows = rows.join(judged, "sample_id", "left").withColumn("judge_enabled", F.col("judge_score").isNotNull())
    else:
        rows = rows.withColumns(
            {
                "judge_enabled": F.lit(False),
                "judge_score": F.lit(None).cast("double"),
                "judge_errors": F.lit(0),
                **{k: F.lit(None).cast("int") for k in ("accuracy", "completeness")},
                "factual_consistency": F.lit(None).cast("double"),
            }
        )
    return S.evaluate(rows, unsupported="unsupported")


def evaluate_batch(
    predictions: DataFrame, dataset: DataFrame, done: DataFrame | None = None, order: str = "position", lex: Lexicons = DEFAULT,
    judged: DataFrame | None = None,
) -> tuple[DataFrame, Joined]:
    """Evaluations of the predictions (sample_id, ``order``, prediction) that have a sample (sample_id, question, reference) and no result in
    ``done``; and the join, whose rows name every prediction and sample that was left out.

    Of a sample with several predictions the first is evaluated.
    """
    joined = join_predictions(predictions, dataset, order=order, done=done)
    pairs = joined.rows.where("outcome = 'pending'").select("sample_id", "question", "reference", F.coalesce("prediction", F.lit("")).alias("prediction"))
    return evaluate(pairs.dropDuplicates(["sample_id"]), lex, judged), joined
