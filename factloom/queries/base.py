"""Relations the queries start from, and helpers to write their SQL."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, WS_CHARS
from ..lexicons import DEFAULT
from ..session import spread

# Lists with terms that occur in the given tables, for the queries below.
SYN = replace(
    DEFAULT,
    noise=("reedes", "license", "cookie", "ereau"),
    legal=("copyright", "all rights"),
    high_value=("tionent", "mentre", "ingand", "cióno"),
    technical=("heed", "eaux", "thern", "tionch", "erin", "unge", "osla", "entre", "http", "email"),
    public_content=("aile", "ndst"),
    topology=("than", "erin", "leaux", "heed"),
    fault=("shed", "once", "vipa", "thth"),
    diagnosis=("heed", "leen", "unge", "ciones"),
    broad=("the", "and", "ing", "re"),
    low_value_sources=("src3.", "/es"),
    project_sources=("src7.", "src11."),
    project_titles=("than", "les"),
    depth=("tion", "ing", "eau", "der", "ndst", "=", "/"),
    causal=("for", "from", "pour", "und", "para", "with"),
    qa=("what", "que", "was", "how"),
    chunk_keywords=("heed", "eaux", "unge"),
    section_stops=("thereed", "eauvi", "copyright"),
    section_stops_cased=("Heed",),
    line_drops=("license", "contact", "leaux"),
    reject_titles=("than", "und "),
    reject_paths=("/fr", "src4"),
    signal=("the", "and", "heed", "que", "der", "los"),
    nav_words=("the", "that", "les", "und"),
    read_nav=("that", "les", "and"),
    boilerplate=("license", "all rights", "contact", "heed"),
    aggregation=("reedes", "eauvi"),
    abbrevs=("the", "and", "que", "les", "und", "der", "los", "with"),
    trusted_hosts=("src1.example.org", "src2.example.org", "src5.example.org"),
    low_value_hosts=("src6.example.org", "example.net"),
    low_value_paths=("/de",),
    low_value_titles=("the", "les"),
    quick_check=("than", "erin", "src1", "the", "les", "eau"),
)


# text tables, whose rows are expensive to work on, with their keys
_TEXT = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str, finer: int = 1) -> DataFrame:
    data = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(data, _TEXT[name], finer=finer) if name in _TEXT else data


# tasks for each one of the scan, where a page takes far longer to read out than to move
READ_OUT = 16


# --- chunks: every document as one chunk of the knowledge base ------------

CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, substr(split_part(text, chr(10), 1), 1, 80) AS title,
         'https://' || source || '.example.org/' || lang AS url, text, source, lang
  FROM documents)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang").alias("url"),
        "text",
        "source",
        "lang",
    )


# --- pairs: question, reference (last answer), prediction (first answer) ----

PAIRS = """pairs AS (
  SELECT conv_id AS sample_id,
         coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '') AS question,
         coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS reference,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS prediction
  FROM conversations GROUP BY conv_id)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.samples import assemble

    turns = table(spark, sf, "conversations")
    answers = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prediction"))
    paired = (
        assemble(turns, "conv_id", "turn", "role", "text")
        .join(answers, "conv_id", "left")
        .select(
            F.col("conv_id").alias("sample_id"), "question", "reference", F.coalesce("prediction", F.lit("")).alias("prediction")
        )
    )
    return spread(paired, "sample_id", scan=False)


# --- evaluation rows: one per order line, the return flag names the run ----

EVAL_COLUMNS = """
  CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'R' THEN 'agent' ELSE 'other' END AS run,
  'P' || CAST(l_partkey AS STRING) AS sample_id,
  l_orderkey * 10 + l_linenumber AS position,
  CAST(l_quantity AS DOUBLE) / 50.0 AS final_score,
  1.0 - CAST(l_discount AS DOUBLE) * 6.0123457 AS semantic,
  CAST(l_tax AS DOUBLE) * 8.0071193 AS claim,
  CAST(l_suppkey % 11 AS DOUBLE) / 10.0 AS entity,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_orderkey % 21 AS DOUBLE) / 20.0 END AS coverage,
  CASE WHEN l_linenumber <= 2 THEN NULL ELSE CAST(l_partkey % 17 AS DOUBLE) / 16.0 END AS required_coverage,
  l_linenumber % 3 = 0 AS core_hit,
  l_orderkey % 13 = 0 AS core_contradicted,
  CAST(l_suppkey % 7 AS INT) AS unsupported,
  l_linestatus = 'O' AS judge_enabled,
  CAST(l_quantity AS DOUBLE) / 50.0 * 0.9 + 0.1 AS judge_score,
  CAST(1 + l_orderkey % 5 AS INT) AS accuracy,
  CAST(1 + l_partkey % 5 AS INT) AS completeness,
  CAST(1 + l_suppkey % 5 AS INT) AS clarity,
  CAST(1 + l_linenumber % 5 AS INT) AS usefulness,
  CAST(l_quantity % 11 AS DOUBLE) / 10.0 AS factual_consistency,
  CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE 0 END AS judge_errors,
  CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS point_errors,
  CASE WHEN l_orderkey % 17 = 0 THEN 'request timed out after ' || CAST(l_linenumber AS STRING) || ' steps'
       WHEN l_partkey % 23 = 0 THEN 'connection reset by peer' END AS error_text,
  CASE WHEN l_orderkey % 19 = 0 THEN 'claim contradicts the reference' END AS judge_error_text,
  l_linenumber >= 6 AS fully_correct
"""
EVALS = f"evals AS (SELECT {EVAL_COLUMNS} FROM lineitem)"


def evals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(*_split(EVAL_COLUMNS))
    as_list = lambda c: F.array_compact(F.array(c))
    return rows.withColumn("errors", as_list("error_text")).withColumn("judge_error_list", as_list("judge_error_text"))


def _split(block: str) -> list[str]:
    """Select list -> one expression per column (a column ends with its line)."""
    out, part = [], ""
    for line in block.strip().splitlines():
        part = f"{part} {line.strip()}"
        if part.endswith(","):
            out.append(part.rstrip(","))
            part = ""
    return [*out, part] if part else out


# --- event log: a sample is one user's day, a step is one event ------------

LOG = """log AS (
  SELECT CAST(user_id AS STRING) || '@' || strftime(ts, '%Y-%m-%d') AS sample_id, user_id,
         event_id AS step, ts, extract(hour FROM ts) AS slot,
         CASE event_type WHEN 'click' THEN 'web_search' WHEN 'view' THEN 'local_retrieve'
              WHEN 'signup' THEN 'evidence_rank' WHEN 'purchase' THEN 'finish_answer' ELSE 'agent_planner' END AS tool_name,
         value < 150 AS success, value / 10.0 AS elapsed_seconds,
         CASE WHEN value >= 400 THEN 'request timed out' WHEN value >= 150 THEN 'connection refused' END AS error,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value
  FROM events)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    tool = (
        F.when(kind == "click", "web_search")
        .when(kind == "view", "local_retrieve")
        .when(kind == "signup", "evidence_rank")
        .when(kind == "purchase", "finish_answer")
        .otherwise("agent_planner")
    )
    value = F.col("value")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("sample_id"),
        "user_id",
        F.col("event_id").alias("step"),
        "ts",
        F.hour("ts").cast("long").alias("slot"),
        tool.alias("tool_name"),
        (value < 150).alias("success"),
        (value / 10.0).alias("elapsed_seconds"),
        F.when(value >= 400, "request timed out").when(value >= 150, "connection refused").alias("error"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
    )


# --- SQL text helpers -------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_hits(col: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(t)}) AS INT)" for t in terms) + ")"


def sql_any(col: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")"


def sql_in(terms: Iterable[str]) -> str:
    return "(" + ", ".join(q(t) for t in terms) + ")"


def sql_list(terms: Iterable[str]) -> str:
    return "[" + ", ".join(q(t) for t in terms) + "]"


def sql_squeeze(col: str) -> str:
    return f"trim(regexp_replace(coalesce({col}, ''), '{WS}+', ' ', 'g'))"


def sql_strip(col: str) -> str:
    return f"trim({col}, {q(WS_CHARS)})"


def sql_ratio(col: str) -> str:
    return f"(length(regexp_replace({col}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / CAST(greatest(length({col}), 1) AS DOUBLE))"


def sql_lines(col: str) -> str:
    cut = f"string_split(regexp_replace({col}, '\\r\\n?', chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({cut}, lambda x: {sql_strip('x')}), lambda x: length(x) > 0)"


def sql_occ(col: str, term: str) -> str:
    return f"CAST((length({col}) - length(replace({col}, {q(term)}, ''))) / {len(term)} AS INT)"


def sql_occs(col: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(sql_occ(col, t) for t in terms) + ")"
