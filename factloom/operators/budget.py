"""Budgets over ordered logs, and providers tried in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import running_sum

#: Addresses that are not read: their search snippet is kept.  Fixed values of the page rule.
UNREAD_ENDINGS = (".pdf",)
UNREAD_PARTS = ("/pdf/", "/resource/en/datasheet/", "onsemi.com/products/", "st.com/en/power-management/")


def unread(url: Column) -> Column:
    """Pages that are likely binary or blocked."""
    low = F.lower(F.coalesce(url, F.lit("")))
    ending = [F.endswith(low, F.lit(e)) for e in UNREAD_ENDINGS]
    out = T.contains_any(low, UNREAD_PARTS)
    for e in ending:
        out = out | e
    return out


def page_reads(results: DataFrame, keys: list[str], order: list[str], bucket: Column, url: str, read: Column, fallback: Column | None = None,
               budget: int = 2) -> DataFrame:
    """``results`` with ``read_outcome`` of each row of an ordered list of search results, of which pages are read until ``budget`` reads succeeded.

    over_budget  the budget was used up before this row
    skipped      not worth reading; costs nothing
    read         the page was read; fallback: only the second reader got it
    failed       neither reader got it; costs nothing

    Whether a row is reached depends on the successes before it.  Once they fill the budget nothing more is read,
    so the count of rows that would succeed is the count of successes as long as it is below the budget: a running sum,
    linked over ``bucket`` (a coarse step of the order), so that no list sits in one task.
    """
    second = F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))
    first = F.coalesce(read, F.lit(False))
    staged = results.withColumn("_skip", unread(F.col(url))).withColumn("_first", first).withColumn("_second", second)
    gain = (~F.col("_skip") & (F.col("_first") | F.col("_second"))).cast("long")
    staged = running_sum(staged.withColumn("_gain", gain), keys, order, bucket, "_gain", "_sum")
    outcome = (
        F.when(F.col("_sum") - F.col("_gain") >= budget, "over_budget")
        .when(F.col("_skip"), "skipped")
        .when(F.col("_first"), "read")
        .when(F.col("_second"), "fallback")
        .otherwise("failed")
    )
    return staged.withColumn("read_outcome", outcome).drop("_skip", "_first", "_second", "_gain", "_sum")


def provider_outcomes(calls: DataFrame, results: DataFrame, query: str, order: tuple[str, ...], provider: str = "provider", error: str = "error",
                      elapsed: str | None = None, timeout: float | None = None) -> DataFrame:
    """(query, provider, results, outcome, reason) of every provider that a query called: the first of ``order`` with any result wins.

    ``calls`` has a row per query and provider with an error or null, ``results`` the rows that came.  A provider that failed or
    was late has no results, whatever came.  Of a repeated call the least error counts, and the longest time.

    won, not_reached (after the winner), failed (with the error), late, empty ("no results"), unlisted (not in ``order``)
    """
    name = lambda c: F.lower(F.trim(F.col(c)))
    late = F.max(F.col(elapsed) > timeout) if elapsed and timeout is not None else F.lit(False)
    called = calls.groupBy(query, name(provider).alias("provider")).agg(F.min(error).alias("_error"), F.coalesce(late, F.lit(False)).alias("_late"))
    # counting first: a query with very many rows is one row a task from here on
    counted = results.groupBy(query, name(provider).alias("provider")).agg(F.count("*").alias("results"))
    known = called.join(counted, [query, "provider"], "full").fillna({"results": 0, "_late": False})
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    known = known.withColumn("_rank", F.when(rank > 0, rank))
    able = (F.col("results") > 0) & F.col("_error").isNull() & ~F.col("_late") & F.col("_rank").isNotNull()
    winner = known.where(able).groupBy(query).agg(F.min("_rank").alias("_winner"))
    told = known.join(winner, query, "left")
    outcome = (
        F.when(F.col("_rank").isNull(), "unlisted")
        .when(F.col("_rank") == F.col("_winner"), "won")
        .when(F.col("_rank") > F.col("_winner"), "not_reached")
        .when(F.col("_error").isNotNull(), "failed")
        .when(F.col("_late"), "late")
        .otherwise("empty")
    )
    told = told.withColumn("outcome", outcome)
    reason = (
        F.when(F.col("outcome") == "failed", F.concat_ws(": ", "provider", "_error"))
        .when(F.col("outcome") == "late", F.concat_ws(": ", "provider", F.lit("timed out")))
        .when(F.col("outcome") == "empty", F.concat_ws(": ", "provider", F.lit("no results")))
    )
    return told.select(query, "provider", "results", "outcome", reason.alias("reason"))


def first_provider(calls: DataFrame, results: DataFrame, query: str, order: tuple[str, ...], provider: str = "provider", **options) -> DataFrame:
    """The rows of ``results`` that the winning provider of their query returned."""
    won = provider_outcomes(calls, results, query, order, provider, **options).where("outcome = 'won'")
    won = won.select(F.col(query).alias("_query"), F.col("provider").alias("_won"))
    return results.join(won, (F.col(query) == F.col("_query")) & (F.lower(F.trim(F.col(provider))) == F.col("_won")), "left_semi")
