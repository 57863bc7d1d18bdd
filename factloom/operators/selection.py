"""Row sets by id lists, resume, repair and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import keep_last


def by_id_list(items: DataFrame, key: str, ids: DataFrame, position: str, order: str, empty_means_all: bool = True) -> DataFrame:
    """Rows named in an id list, numbered in list order; of several rows with
    one id the last counts.  ``ids`` has ``key`` and ``position``."""
    if empty_means_all and ids.isEmpty():
        return items
    wanted = ids.groupBy(key).agg(F.min(position).alias("list_position"))
    return keep_last(items, key, order).drop("first_position").join(wanted, key)


def remaining(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Samples not yet in the output."""
    return samples.join(done.select(key).distinct(), key, "left_anti")


def repaired(rows: DataFrame, renewed: DataFrame, key: str, broken: Column) -> DataFrame:
    """Rows whose test fails are replaced by the renewed row where one exists."""
    fresh = renewed.select(F.col(key), F.struct(*[c for c in rows.columns if c != key]).alias("_new"))
    joined = rows.withColumn("_broken", broken).join(fresh, key, "left")
    use = F.col("_broken") & F.col("_new").isNotNull()
    return joined.select(
        key, *[F.when(use, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in rows.columns if c != key]
    )


def seeded_sample(df: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """Reproducible sample in a random order that depends on id and seed only."""
    ticket = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.select(key, ticket.alias("ticket")).orderBy("ticket", key).limit(limit)


def generation_failed(answer: Column) -> Column:
    text = T.strip(F.coalesce(answer, F.lit("")))
    return (F.length(text) == 0) | F.contains(text, F.lit("[ERROR]")) | F.contains(text, F.lit("生成失败"))


def hard_failed(answer: Column, errors: Column) -> Column:
    return (F.coalesce(F.size(errors), F.lit(0)) > 0) | generation_failed(answer)
