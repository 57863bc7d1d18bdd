"""Deduplication, chunking and the knowledge base builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, dedup
from ..plans import knowledge_base as kb
from . import query
from .base import (
    CHUNKS, EVALS, SYN, chunks, evals, q, sql_any, sql_lines, sql_ratio, sql_squeeze, table,
)
from .sourcing import _boilerplate_sql

# ----------------------------------------------------------------- duplicates

_EVENT_COLUMNS = "user_id, event_id, event_type, value"


@query(
    "dedupe_keep_first",
    f"""SELECT {_EVENT_COLUMNS}, event_id AS first_position FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
)
def dedupe_keep_first(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return dedup.keep_first(events, "user_id", "event_id")


@query(
    "dedupe_keep_last",
    f"""SELECT {_EVENT_COLUMNS}, min(event_id) OVER (PARTITION BY user_id) AS first_position FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def dedupe_keep_last(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return dedup.keep_last(events, "user_id", "event_id")


@query(
    "dedupe_prefer_success",
    f"""WITH e AS (SELECT *, event_type = 'purchase' AS ok FROM events)
        SELECT {_EVENT_COLUMNS}, ok, min(event_id) OVER (PARTITION BY user_id) AS first_position FROM e
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, event_id DESC) = 1""",
)
def dedupe_prefer_success(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", (F.col("event_type") == "purchase").alias("ok")
    )
    return dedup.prefer_success(events, "user_id", "event_id", "ok")


@query(
    "content_hash_dedup",
    f"""SELECT min(doc_id) AS doc_id, sha1({sql_squeeze('text')}) AS key, count(*) AS copies FROM documents GROUP BY 2""",
)
def content_hash_dedup(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", dedup.content_key(T.squeeze(F.col("text"))).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "prefix_dedup",
    f"""WITH k AS (SELECT doc_id, CASE WHEN length({sql_squeeze('text')}) <= 80 THEN {sql_squeeze('text')}
          ELSE substr({sql_squeeze('text')}, 1, 80) || '...' END AS key FROM documents)
        SELECT min(doc_id) AS doc_id, md5(key) AS key FROM k WHERE key <> '' GROUP BY key""",
)
def prefix_dedup(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", dedup.prefix_key(F.col("text")).alias("key"))
    first = dedup.keep_first(keyed, "key", "doc_id")
    return first.select("doc_id", F.md5(F.encode("key", "UTF-8")).alias("key"))


@query(
    "evidence_dedup",
    f"""WITH k AS (SELECT doc_id, trim(lower(source)) || chr(10) || lang || chr(10) || trim(lower(CASE WHEN length({sql_squeeze('text')}) <= 240
          THEN {sql_squeeze('text')} ELSE substr({sql_squeeze('text')}, 1, 240) || '...' END)) AS key FROM documents)
        SELECT min(doc_id) AS doc_id, md5(key) AS key FROM k GROUP BY key""",
)
def evidence_dedup(spark, sf):
    key = dedup.evidence_key(F.col("source"), F.col("lang"), F.col("text"))
    first = dedup.keep_first(table(spark, sf, "documents").select("doc_id", key.alias("key")), "key", "doc_id")
    return first.select("doc_id", F.md5(F.encode("key", "UTF-8")).alias("key"))


def _round_sql(n: int) -> str:
    """One round of the two-key scan as SQL: winners, then what is left."""
    return f"""w{n} AS (SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY a) AS fa, min(doc_id) OVER (PARTITION BY b) AS fb FROM u{n}) WHERE fa = doc_id AND fb = doc_id),
      u{n + 1} AS (SELECT doc_id, a, b FROM u{n} WHERE a NOT IN (SELECT a FROM w{n}) AND b NOT IN (SELECT b FROM w{n}))"""


@query(
    "page_dedup_two_keys",
    f"""WITH u0 AS (SELECT doc_id, source || '/' || CAST(n_chars AS VARCHAR) AS a, sha1(text) AS b FROM documents),
      {", ".join(_round_sql(i) for i in range(6))}
      SELECT doc_id FROM ({" UNION ALL ".join(f"SELECT doc_id FROM w{i}" for i in range(6))})""",
)
def page_dedup_two_keys(spark, sf):
    """Sequential dedup by address and text hash."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("n_chars").cast("string")).alias("a"),
        F.sha1(F.encode("text", "UTF-8")).alias("b"),
    )
    return dedup.first_by_any_key(docs, ["a", "b"], "doc_id").select("doc_id")


# ------------------------------------------------------------------- chunks

_FLAT = f"array_to_string({sql_lines('text')}, chr(10))"
_WINDOW = "substr(flat, CAST(start + 1 AS BIGINT), 900)"


def _rfind(mark: str, size: int) -> str:
    """0-based position in the text of the last mark inside the window, else -1."""
    return (
        f"CASE WHEN contains({_WINDOW}, {mark}) THEN start + 900 - (strpos(reverse({_WINDOW}), reverse({mark})) - 1) - {size} ELSE -1 END"
    )


_CHUNK_SQL = f"""WITH RECURSIVE f AS (SELECT doc_id, {_FLAT} AS flat FROM documents),
  g AS (SELECT doc_id, flat, length(flat) AS n FROM f WHERE length(flat) >= 160),
  r(doc_id, flat, n, start, stop) AS (
    SELECT doc_id, flat, n, 0, CASE WHEN n <= 900 THEN n ELSE -1 END FROM g
    UNION ALL
    SELECT doc_id, flat, n, CASE WHEN stop < 0 THEN start ELSE greatest(stop - 120, start + 1) END,
      CASE WHEN stop >= 0 THEN -1 WHEN start + 900 >= n THEN n
        WHEN greatest({_rfind("chr(10)", 1)}, {_rfind("'. '", 2)}, {_rfind("'。'", 1)}, {_rfind("'；'", 1)}) > start + 450
        THEN greatest({_rfind("chr(10)", 1)}, {_rfind("'. '", 2)}, {_rfind("'。'", 1)}, {_rfind("'；'", 1)}) + 1
        ELSE start + 900 END
    FROM r WHERE stop < n),
  c AS (SELECT doc_id, CAST(start AS INT) AS char_start, CAST(stop AS INT) AS char_end,
        trim(substr(flat, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), {q(T.WS_CHARS)}) AS chunk FROM r WHERE stop >= 0)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS INT) AS chunk_index, char_start, char_end, md5(chunk) AS digest
  FROM c WHERE length(chunk) >= 160"""


@query("overlap_chunks", _CHUNK_SQL)
def overlap_chunks(spark, sf):
    out = chunking.overlap_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "chunk_index", "char_start", "char_end", F.md5(F.encode("chunk_text", "UTF-8")).alias("digest"))


@query("section_chunks")
def section_chunks(spark, sf):
    """Paragraph breaks are put between the lines so that every branch is used."""
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = chunking.section_chunks(docs, "text")
    return out.select("doc_id", "chunk_index", F.length("chunk_text").alias("chars"), F.md5(F.encode("chunk_text", "UTF-8")).alias("digest"))


@query(
    "fixed_stride_chunks",
    f"""WITH f AS (SELECT doc_id, {_FLAT} AS flat FROM documents),
      s AS (SELECT doc_id, flat, unnest(range(0, greatest(length(flat) - 121, 0) + 1, 780)) AS at FROM f)
      SELECT doc_id, CAST(at / 780 AS INT) AS chunk_index, CAST(at AS INT) AS char_start, CAST(least(at + 900, length(flat)) AS INT) AS char_end,
        md5(substr(flat, at + 1, 900)) AS digest FROM s""".replace(" AS at", " AS pos").replace("(at", "(pos").replace(" at +", " pos +"),
)
def fixed_stride_chunks(spark, sf):
    out = chunking.stride_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "chunk_index", "char_start", "char_end", F.md5(F.encode("chunk_text", "UTF-8")).alias("digest"))


@query("article_split")
def article_split(spark, sf):
    """Documents joined to heading-separated pages per line, then split again."""
    body = F.regexp_replace("text", "\n", "\n\n## Section heading\n")
    docs = table(spark, sf, "documents").select("doc_id", body.alias("body"), F.substring("text", 1, 60).alias("title"))
    out = chunking.split_articles(docs, "body", "title")
    return out.select("doc_id", "article_rank", F.length("article").alias("chars"))


# ------------------------------------------------------------------ builders


def _pages(spark, sf):
    return chunks(spark, sf).withColumn("text_hash", F.sha1(F.encode("text", "UTF-8"))).withColumnRenamed("chunk_id", "page_id")


_UNIQUE_URL = "url || '/' || CAST(page_id AS VARCHAR)"


@query(
    "kb_build_counts",
    f"""WITH {CHUNKS}, f AS (SELECT chunk_id AS page_id, title, url || '/' || CAST(chunk_id AS VARCHAR) AS url, text, sha1(text) AS b, {sql_squeeze('text')} AS flat FROM chunks),
      l AS (SELECT *, lower(title || chr(10) || url || chr(10) || flat) AS low, lower({sql_squeeze("title || chr(10) || flat")}) AS titled FROM f),
      o AS (SELECT *, CASE WHEN length(flat) < 160 THEN 'short' WHEN {sql_any('lower(url)', SYN.low_value_sources)} THEN 'low_value_source'
        WHEN {sql_any('low', SYN.noise)} AND length(flat) < 1200 THEN 'noise' WHEN {_boilerplate_sql('titled')} THEN 'boilerplate'
        WHEN {sql_ratio('flat')} < 0.35 THEN 'symbols' END AS reason FROM l),
      d AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL, b ORDER BY page_id) END AS nth FROM o)
      SELECT CASE WHEN reason IS NOT NULL THEN reason WHEN nth > 1 THEN 'duplicate'
        WHEN length(array_to_string({sql_lines('text')}, chr(10))) < 160 THEN 'no_chunks' ELSE 'kept' END AS outcome, count(*) AS pages FROM d GROUP BY 1""",
)
def kb_build_counts(spark, sf):
    pages = _pages(spark, sf).withColumn("url", F.concat("url", F.lit("/"), F.col("page_id").cast("string")))
    return kb.counters(kb.basic(pages, "page_id", SYN, exact=False).funnel)


@query("kb_public_chunks")
def kb_public_chunks(spark, sf):
    pages = _pages(spark, sf).withColumn("url", F.concat("url", F.lit("/"), F.col("page_id").cast("string")))
    built = kb.filtered_public(pages, "page_id", SYN, exact=False)
    return built.unnumbered.select("page_id", "chunk_index", "char_start", "char_end", F.length("chunk_text").alias("chars"))


@query("kb_quality_chunks")
def kb_quality_chunks(spark, sf):
    pages = _pages(spark, sf).withColumn("url", F.concat("url", F.lit("/"), F.col("page_id").cast("string")))
    built = kb.high_quality(pages, "page_id", lex=SYN)
    return built.unnumbered.select("page_id", "chunk_index", "quality", F.length("text").alias("chars"))


@query(
    "run_rows_latest",
    f"""WITH {EVALS} SELECT run, sample_id, position, final_score FROM evals
        QUALIFY row_number() OVER (PARTITION BY run, sample_id ORDER BY position DESC) = 1""",
)
def run_rows_latest(spark, sf):
    rows = evals(spark, sf).withColumn("key", F.concat_ws("|", "run", "sample_id"))
    return dedup.keep_last(rows.select("key", "run", "sample_id", "position", "final_score"), "key", "position").select(
        "run", "sample_id", "position", "final_score"
    )
