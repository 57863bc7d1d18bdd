"""Images that belong to samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, post_id, file_name, depth`` of every file; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.regexp_replace("path", f"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    return files.select(
        "path",
        "length",
        F.substring_index(below, "/", 1).alias("post_id"),
        F.substring_index("path", "/", -1).alias("file_name"),
        F.size(F.split(below, "/")).alias("depth"),
    )


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (post_id, original_url) with the shallowest file of that name in
    the sample's folder; ``exists`` is false without one."""
    best = files.groupBy("post_id", "file_name").agg(F.min_by("path", F.struct("depth", "path")).alias("path"))
    name = F.substring_index(F.regexp_replace("original_url", r"[?#].*$", ""), "/", -1)
    joined = refs.withColumn("file_name", name).join(best, ["post_id", "file_name"], "left")
    return joined.withColumn("exists", F.col("path").isNotNull()).drop("file_name")


def data_urls(spark: SparkSession, root: str) -> DataFrame:
    """``path, data_url`` with the file's bytes in base64."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    mime = F.coalesce(F.element_at(table, kind), F.lit("application/octet-stream"))
    body = F.regexp_replace(F.base64("content"), "[\r\n]", "")
    return files.select("path", F.concat(F.lit("data:"), mime, F.lit(";base64,"), body).alias("data_url"))
