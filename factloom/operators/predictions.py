"""Predictions joined to their dataset, with what the join leaves out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T

#: What a row of the join may be.
OUTCOMES = ("pending", "resumed", "skipped", "missing", "repeated")


@dataclass(frozen=True)
class Joined:
    """``rows`` has every prediction and every sample once, with ``outcome``; ``counts`` is filled by the first action on ``rows``."""

    rows: DataFrame
    counts: Observation

    @property
    def pending(self) -> DataFrame:
        """What is left to evaluate: repeated predictions as well, as each row of a file is."""
        return self.rows.where("outcome IN ('pending', 'repeated')").drop("outcome")


def join_predictions(predictions: DataFrame, dataset: DataFrame, key: str = "sample_id", order: str = "position", done: DataFrame | None = None) -> Joined:
    """One full outer join of predictions and samples.

    pending   a prediction with a sample
    resumed   its sample has a result in ``done`` already (checked before the dataset)
    skipped   a prediction without a sample
    missing   a sample without a prediction
    repeated  a prediction of a sample that has one earlier in ``order``

    Predictions and dataset share no column but the key.

    Keys are compared as trimmed text; a prediction without a key is skipped, a sample without one is missing.
    """
    name = T.blank_to_null(F.trim(F.col(key).cast("string")))
    asked = predictions.withColumn("_key", name).drop(key)
    known = dataset.withColumn("_key", name).drop(key)
    # rows without a key meet nothing: they stay out of the join, where they would be one hot key
    nameless = asked.where("_key IS NULL").withColumn("outcome", F.lit("skipped"))
    nameless = nameless.unionByName(known.where("_key IS NULL").withColumn("outcome", F.lit("missing")), allowMissingColumns=True)
    asked, known = asked.where("_key IS NOT NULL"), known.where("_key IS NOT NULL").dropDuplicates(["_key"])
    # the least place of each key, by aggregation: a key with very many rows is no more work for one task
    firsts = asked.groupBy("_key").agg(F.min(order).alias("_first"))
    both = asked.withColumn("_asked", F.lit(True)).join(firsts, "_key").join(known.withColumn("_known", F.lit(True)), "_key", "full")
    finished = asked.select("_key").limit(0) if done is None else done.select(name.alias("_key")).where("_key IS NOT NULL").distinct()
    both = both.join(finished.withColumn("_done", F.lit(True)), "_key", "left")
    outcome = (
        F.when(F.col("_asked").isNull(), "missing")
        .when(F.col("_done"), "resumed")
        .when(F.col("_known").isNull(), "skipped")
        .when(F.col(order) > F.col("_first"), "repeated")
        .otherwise("pending")
    )
    rows = both.withColumn("outcome", outcome).drop("_asked", "_known", "_done", "_first")
    rows = rows.unionByName(nameless, allowMissingColumns=True).withColumnRenamed("_key", key)
    counts = Observation()
    rows = rows.observe(counts, *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return Joined(rows, counts)
