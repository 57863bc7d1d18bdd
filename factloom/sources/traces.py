"""Stored traces: one row per step, spread over a fixed number of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trace import compact_steps


def write(log: DataFrame, folder: str, buckets: int = 256) -> None:
    """Compact steps as JSON; samples share ``buckets`` folders so their number
    does not become the number of files."""
    steps = compact_steps(log).withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)))
    steps.write.mode("overwrite").partitionBy("bucket").json(folder)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Steps and errors per stored trace."""
    schema = "sample_id string, step long, role string, content string, query string, success boolean, error string"
    return spark.read.schema(schema).json(folder).groupBy("sample_id").agg(
        F.count("*").alias("steps"), F.count("error").alias("errors")
    )


def load(spark: SparkSession, folder: str, sample_id: str, buckets: int = 256) -> DataFrame:
    """Steps of one sample; only its folder is read."""
    schema = "sample_id string, step long, role string, content string, query string, success boolean, error string, bucket int"
    stored = spark.read.schema(schema).json(folder)
    mine = F.pmod(F.xxhash64(F.lit(sample_id)), F.lit(buckets))
    return stored.filter((F.col("bucket") == mine) & (F.col("sample_id") == sample_id)).drop("bucket")
