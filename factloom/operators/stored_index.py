"""A term index on disk, read in pieces.

``build`` stores three tables, each split into folders by a hash so that a search reads the folders of its terms only, and sorted inside
its files so that row groups without them are skipped:

``vocabulary``  (bucket, gram, token)                      character trigrams of every distinct token
``postings``    (bucket, token, block, chunk_id, n, dl)    where a token occurs, how often, and how long that chunk is
``bounds``      (bucket, token, block, df, max_n, min_dl)  what bounds a score inside a block

A block is a hash slice of about ``block_chunks`` chunks: what a token that most chunks hold has in a block is bounded, so no task sees a
whole long list.

``search`` finds the tokens that hold each term.  A term that only one token holds is known by the bounds of its blocks; its frequency is
their sum, and no list of it is read yet.  A term inside several tokens has to be counted chunk by chunk, as they may
share chunks; that is done once and gives its exact parts.  Then the most promising blocks of each query are scored.  The k-th best
score found is a floor: of the blocks left only those whose bound reaches it are scored, and only their lists are read.  Others cannot hold a result, so the
answer is the same as that of a full search (``lexical.bm25``).  Two passes are enough, whatever the number of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .lexical import B, CANDIDATES, IDF_FLOOR, K1, _trigrams, lengths, postings
from .ordered import top_k

#: Tokens and terms are put into a scan's filter while they are this few; beyond it they are joined only.
MOST_PUSHED = 500
#: Places of lists that a search reads without looking at the bounds of their blocks.
MOST_DIRECT = 5_000_000


@dataclass(frozen=True)
class Index:
    path: str
    chunks: int
    average: float
    blocks: int
    buckets: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, path: str, chunk_id: str = "chunk_id", title: str = "title", url: str = "url", body: str = "text",
          block_chunks: int = 1024, buckets: int | None = None) -> Index:
    """Index ``chunks`` under ``path``, which holds no index yet.  The summary is written last: an index without it is not complete."""
    spark = chunks.sparkSession
    total, average = lengths(chunks, chunk_id, title, url, body).agg(F.count("*"), F.avg("dl")).first()
    blocks = max(1, -(-total // block_chunks))
    buckets = buckets or min(4096, max(8, total // 20_000))
    posts = postings(chunks, chunk_id, title, url, body, with_length=True)
    posts = posts.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    posts = posts.select(_bucket(F.col("token"), buckets).alias("bucket"), "token", "block", "chunk_id", "n", "dl")
    _store(posts, f"{path}/postings", ["token", "block"])
    stored = spark.read.parquet(f"{path}/postings")
    bounds = stored.groupBy("bucket", "token", "block").agg(F.count("*").alias("df"), F.max("n").alias("max_n"), F.min("dl").alias("min_dl"))
    _store(bounds, f"{path}/bounds", ["token", "block"])
    tokens = spark.read.parquet(f"{path}/bounds").select("token").distinct()
    grams = tokens.withColumn("gram", F.explode(_trigrams(F.col("token")))).withColumn("bucket", _bucket(F.col("gram"), buckets))
    _store(grams, f"{path}/vocabulary", ["gram", "token"])
    summary = [(total, float(average or 0.0), blocks, buckets)]
    spark.createDataFrame(summary, "chunks long, average double, blocks long, buckets long").coalesce(1).write.json(f"{path}/summary")
    return Index(path, total, float(average or 0.0), blocks, buckets)


def _store(rows: DataFrame, path: str, order: list[str]) -> None:
    """One folder a bucket, sorted inside its files; a bucket is dealt to a few tasks, as buckets are few and a hot one may be large."""
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(*order), F.lit(4)))
    dealt.sortWithinPartitions("bucket", *order).write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` stored; an error if it is not complete."""
    row = spark.read.schema("chunks long, average double, blocks long, buckets long").json(f"{path}/summary").first()
    if row is None:
        raise ValueError(f"no complete index in {path}")
    return Index(path, row["chunks"], row["average"], row["blocks"], row["buckets"])


def _pruned(table: DataFrame, keys: DataFrame, column: str, buckets: int) -> DataFrame:
    """The folders of the keys (there are ``buckets`` at most), and in them the keys themselves while they are few."""
    own = keys.select(F.col(column).alias("k")).distinct()
    wanted = [r[0] for r in own.select(_bucket(F.col("k"), buckets).alias("b")).distinct().collect()]
    few = [r[0] for r in own.limit(MOST_PUSHED + 1).collect()]
    table = table.where(F.col("bucket").isin(wanted))
    return table.where(F.col(column).isin(few)) if len(few) <= MOST_PUSHED else table


def matches(index: Index, wanted: DataFrame) -> DataFrame:
    """(term, token, occ): how often each term occurs inside each token of the vocabulary."""
    spark = wanted.sparkSession
    probe = wanted.select("term").distinct().where(F.length("term") >= 3).withColumn("gram", F.substring("term", 1, 3))
    grams = _pruned(index.table(spark, "vocabulary"), probe, "gram", index.buckets)
    inside = grams.select("gram", "token").join(probe, "gram").where(F.contains("token", "term"))
    # a token with white space is an expansion phrase, which only itself matches
    inside = inside.where(~F.contains("token", F.lit(" ")) | (F.col("token") == F.col("term")))
    return inside.select("term", "token", T.occurrences(F.col("token"), F.col("term")).cast("long").alias("occ"))


def _part(idf: Column, tf: Column, dl: Column, average: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


@dataclass(frozen=True)
class Plan:
    """What a search knows before it scores: weights of terms, exact counts of terms inside several tokens, and the highest score
    that a block can give a query."""

    index: Index
    wanted: DataFrame  # query, term
    single: DataFrame  # term, token, occ of the terms that one token holds
    several: DataFrame  # term, block, chunk_id, tf, dl of the others
    weights: DataFrame  # term, idf
    bounds: DataFrame  # query, block, bound


def _tokens(queries: DataFrame, index: Index, query_id: str, terms: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """wanted (query, term), single and many (term, token, occ), and the postings of the latter counted by chunk."""
    spark = queries.sparkSession
    wanted = cut_lineage(queries.select(query_id, F.explode(F.array_distinct(F.transform(terms, F.lower))).alias("term")))
    found = matches(index, wanted)
    found = cut_lineage(found.withColumn("tokens", F.count("*").over(Window.partitionBy("term"))))
    single, many = found.where("tokens = 1").drop("tokens"), found.where("tokens > 1").drop("tokens")
    lists = _pruned(index.table(spark, "postings"), many, "token", index.buckets).join(many, "token")
    several = lists.groupBy("term", "block", "chunk_id").agg(F.sum(F.col("n") * F.col("occ")).alias("tf"), F.first("dl").alias("dl"))
    return wanted, single, many, cut_lineage(several)


def _weights(index: Index, df: DataFrame) -> DataFrame:
    idf = F.ln((index.chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("term", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"))


def _heads(index: Index, single: DataFrame) -> DataFrame:
    heads = _pruned(index.table(single.sparkSession, "bounds"), single, "token", index.buckets).join(single, "token")
    return heads.select("term", "token", "block", "df", (F.col("max_n") * F.col("occ")).alias("tf"), F.col("min_dl").alias("dl"))


def plan(queries: DataFrame, index: Index, query_id: str, terms: str = "fts_terms") -> Plan:
    wanted, single, _, several = _tokens(queries, index, query_id, terms)
    # a part grows with the count and shrinks with the length, so these two bound it
    counted = several.groupBy("term", "block").agg(F.count("*").alias("df"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    most = cut_lineage(_heads(index, single).drop("token").unionByName(counted))
    weights = cut_lineage(_weights(index, most.groupBy("term").agg(F.sum("df").alias("df"))))
    bound = most.join(weights, "term").select("term", "block", _part(F.col("idf"), F.col("tf"), F.col("dl"), index.average or 1.0).alias("bound"))
    bounds = cut_lineage(wanted.join(bound, "term").groupBy(query_id, "block").agg(F.sum("bound").alias("bound")))
    return Plan(index, wanted, cut_lineage(single), several, weights, bounds)


def scores(plan: Plan, pairs: DataFrame, query_id: str) -> DataFrame:
    """(query, chunk_id, score) of all chunks of the given pairs of query and block that hold a term."""
    asked = pairs.join(plan.wanted, query_id)
    needed = asked.select("term", "block").distinct()
    tokens = needed.join(plan.single, "term")
    lists = _pruned(plan.index.table(pairs.sparkSession, "postings"), tokens, "token", plan.index.buckets).join(tokens, ["token", "block"])
    single = lists.select("term", "block", "chunk_id", (F.col("n") * F.col("occ")).alias("tf"), "dl")
    tf = single.unionByName(plan.several.join(needed, ["term", "block"], "left_semi"))
    part = _part(F.col("idf"), F.col("tf"), F.col("dl"), plan.index.average or 1.0)
    parts = tf.join(plan.weights, "term").select("term", "block", "chunk_id", part.alias("part"))
    return asked.join(parts, ["term", "block"]).groupBy(query_id, "chunk_id").agg(F.sum("part").alias("score"))


def blocks_to_read(plan: Plan, query_id: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """First pass: the scores of the blocks with the highest bounds of each query; and the pairs (query, block) left to read."""
    first = max(2, math.ceil(2 * limit * plan.index.blocks / max(1, plan.index.chunks)))
    best = cut_lineage(top_k(plan.bounds, [query_id], [F.desc("bound"), F.col("block")], first, "_place").drop("_place"))
    begun = cut_lineage(scores(plan, best.select(query_id, "block"), query_id))
    place = top_k(begun, [query_id], [F.desc("score"), F.col("chunk_id")], limit, "_place")
    floor = place.where(F.col("_place") == limit).select(query_id, F.col("score").alias("floor"))
    left = plan.bounds.join(best.select(query_id, "block"), [query_id, "block"], "left_anti").join(floor, query_id, "left")
    # scores are compared to nine places, so a bound within that of the floor may still tie
    return begun, left.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-8)).select(query_id, "block")


def search(queries: DataFrame, index: Index, query_id: str, limit: int = CANDIDATES, terms: str = "fts_terms", most_direct: int = MOST_DIRECT) -> DataFrame:
    """Best ``limit`` chunks per query, as ``lexical.bm25`` gives them (scores negative, lower is better, with ``rank``).

    Where the lists that are left to read after the counting are short in sum (``most_direct`` places, known from the bounds), they are simply
    read; block by block otherwise.
    """
    wanted, single, _, several = _tokens(queries, index, query_id, terms)
    left = _heads(index, single).agg(F.sum("df")).first()[0] or 0
    if left <= most_direct:
        lists = _pruned(index.table(queries.sparkSession, "postings"), single, "token", index.buckets).join(single, "token")
        tf = several.unionByName(lists.select("term", "block", "chunk_id", (F.col("n") * F.col("occ")).alias("tf"), "dl"))
        weights = _weights(index, tf.groupBy("term").agg(F.count("*").alias("df")))
        part = _part(F.col("idf"), F.col("tf"), F.col("dl"), index.average or 1.0)
        parts = tf.join(weights, "term").select("term", "chunk_id", part.alias("part"))
        ranked = wanted.join(parts, "term").groupBy(query_id, "chunk_id").agg((-F.sum("part")).alias("bm25_score"))
    else:
        ready = plan(queries, index, query_id, terms)
        begun, pairs = blocks_to_read(ready, query_id, limit)
        ranked = begun.unionByName(scores(ready, pairs, query_id)).select(query_id, "chunk_id", (-F.col("score")).alias("bm25_score"))
    return top_k(ranked, [query_id], [F.round("bm25_score", 9), F.col("chunk_id")], limit)


def contains_search(queries: DataFrame, chunks: DataFrame, query_id: str, limit: int = CANDIDATES, most_terms: int = 256) -> DataFrame | None:
    """``lexical.like_search`` by one scan of titles and texts, if the terms of all queries are few enough to be part of the scan; else None."""
    wanted = queries.select(query_id, F.explode(F.array_distinct(F.transform("like_terms", F.lower))).alias("term"))
    wanted = cut_lineage(wanted.where(T.strip(F.col("term")) != ""))
    few = [r[0] for r in wanted.select("term").distinct().limit(most_terms + 1).collect()]
    if len(few) > most_terms:
        return None
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "text")]
    texts = chunks.select("chunk_id", fields[0].alias("_title"), fields[1].alias("_text"))
    asked = F.array(*[F.lit(t) for t in few]) if few else F.array().cast("array<string>")
    inside = F.filter(asked, lambda t: F.contains("_title", t) | F.contains("_text", t))
    hits = texts.select("chunk_id", F.explode(inside).alias("term")).join(wanted, "term").select(query_id, "chunk_id").distinct()
    return top_k(hits.withColumn("bm25_score", F.lit(10.0)), [query_id], [F.col("chunk_id")], limit)
