"""Incremental runs: new input lines are worked off, finished samples skipped, unusable lines kept with a reason."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

REJECTS = "line string, reason string"


def parsed_lines(lines: DataFrame, schema: StructType, key: str, column: str = "value") -> DataFrame:
    """Lines with ``row`` (null if unusable) and ``reason``: not_json, wrong_type (JSON that does not fit the schema), no_key; blank lines leave."""
    marked = StructType([*schema.fields, StructField("_corrupt", StringType())])
    row = F.from_json(column, marked, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    staged = lines.where(F.trim(F.col(column)) != "").select(F.col(column).alias("line"), row.alias("_row"))
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull()
    keyed = F.coalesce(F.trim(F.col(f"_row.{key}").cast("string")), F.lit("")) != ""
    is_object = F.try_parse_json("line").isNotNull()
    reason = F.when(bad & ~is_object, "not_json").when(bad, "wrong_type").when(~keyed, "no_key")
    fields = F.struct(*[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])
    return staged.select("line", F.when(reason.isNull(), fields).alias("row"), reason.alias("reason"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def resume_stream(
    spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame],
    rejects: str | None = None,
) -> StreamingQuery:
    """Append ``work(new samples)`` to the Parquet folder ``sink``.

    Keys that are done are kept in a table of their own (``<sink>.done``), so a batch reads keys, never results.  Each batch of each checkpoint has
    its own folder in the sink, in the done-table and in ``rejects`` (default ``<sink>.rejects``), which is replaced when the batch is
    run again: a batch that is repeated after a failure, or a sample that arrives twice, adds nothing.
    """
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    done_root, rejects = f"{sink}.done", rejects or f"{sink}.rejects"

    def append(batch: DataFrame, number: int) -> None:
        session, own = batch.sparkSession, f"run={run}/batch={number}"
        lines = parsed_lines(batch, schema, key).persist()
        lines.where("reason IS NOT NULL").select("line", "reason").write.mode("overwrite").parquet(f"{rejects}/{own}")
        fresh = lines.where("reason IS NULL").select("row.*").dropDuplicates([key])
        if _exists(session, done_root):
            done = session.read.option("basePath", done_root).schema(f"`{key}` string, run string, batch long").parquet(f"{done_root}/*/*")
            before = done.where((F.col("run") != run) | (F.col("batch") != number)).select(F.col(key).alias("_done")).distinct()
            fresh = fresh.join(before, F.col(key).cast("string") == F.col("_done"), "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{sink}/{own}")
        # what is done is what was stored
        stored = session.read.parquet(f"{sink}/{own}").select(F.col(key).cast("string").alias(key))
        stored.write.mode("overwrite").parquet(f"{done_root}/{own}")
        lines.unpersist()

    stream = spark.readStream.text(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
