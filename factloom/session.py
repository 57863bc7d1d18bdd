"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "factloom") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def spread(df: DataFrame, *keys: str, scan: bool = True, finer: int = 1) -> DataFrame:
    """Give heavy per-row work one partition per core.

    A scan that is already split into enough tasks is left alone, so large
    inputs are never shuffled for this; a few big files, or the small result of
    a shuffle that adaptive execution would pack into one task, are dealt out
    by key.

    With ``finer``, each task of the scan is dealt to so many, for work that takes far longer than
    a shuffle of its input: tasks get more with the input, not longer.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if finer > 1:
        return df.repartition(max(cores, df.rdd.getNumPartitions() * finer), *keys)
    if scan and df.rdd.getNumPartitions() >= cores:
        return df
    if not scan:
        cores = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(cores, *keys)


_SCRATCH: dict[str, str] = {}
_TABLES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``.  Only a session on one machine (tests) may name none; it gets a
    scratch folder of its own.  Executors elsewhere could not see that, so a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _SCRATCH:
            _SCRATCH[app] = tempfile.mkdtemp(prefix="factloom-")
        folder = _SCRATCH[app]
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Lost executors then repeat a scan, not the work before it, and the planner
    sees real sizes and single columns.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` returned, once what was made of it is stored."""
    path = table._cut_path
    if path in _TABLES:
        _TABLES.remove(path)
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the tables that ``cut_lineage`` has written so far, when their results are stored.  Returns their number."""
    conf = spark._jsc.hadoopConfiguration()
    gone = 0
    while _TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
