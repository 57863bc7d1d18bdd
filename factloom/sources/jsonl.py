"""Line-delimited JSON: strict and tolerant reads, append and replace."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import text as T


def read(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the job or is dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def safe(df: DataFrame) -> DataFrame:
    """String columns without control characters, numbers without NaN or infinity."""
    fixed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType):
            fixed[field.name] = T.json_safe_text(F.col(field.name))
        elif field.dataType.typeName() in ("double", "float"):
            fixed[field.name] = T.json_safe_number(F.col(field.name))
    return df.withColumns(fixed) if fixed else df


def append(df: DataFrame, path: str) -> None:
    safe(df).write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Write to a new folder, then swap it in by renaming: a job that fails leaves the old rows as they were."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    safe(df).write.json(fresh)
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(at(path))
    if had and not files.rename(at(path), at(old)):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(at(fresh), at(path)):
        if had:
            files.rename(at(old), at(path))
        raise OSError(f"cannot move the new rows to {path}")
    if had:
        files.delete(at(old), True)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id, position`` of an id list file: comments and blank lines skipped,
    the first place of a repeated id counts."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("position", "_l")).withColumn("id", T.strip(F.col("_l")))
    kept = lines.filter((F.length("id") > 0) & ~F.startswith("id", F.lit("#")))
    return kept.groupBy("id").agg(F.min("position").alias("position"))


def write_ids(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
