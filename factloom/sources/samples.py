"""Question/answer samples from message lists and turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.ordered import ordered_text

TURN_BLOCK = 4096  # turns joined per step when a conversation is assembled

# Message content is a string or a list of parts; it is read as raw JSON text.
DATASET = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField(
            "messages",
            T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])),
        ),
    ]
)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).json(path, mode="FAILFAST")


def _parts(message: Column) -> Column:
    """Text and image parts of one message."""
    listed = F.from_json(
        message["content"], "array<struct<type string, text string, image_url struct<url string>>>"
    )
    plain = F.array(
        F.struct(
            F.lit("text").alias("type"),
            message["content"].alias("text"),
            F.struct(F.lit(None).cast("string").alias("url")).alias("image_url"),
        )
    )
    return F.when(F.startswith(F.ltrim(message["content"]), F.lit("[")) & listed.isNotNull(), listed).otherwise(plain)


def parse_dataset(rows: DataFrame) -> DataFrame:
    """``sample_id, question, reference, images`` from rows with a message list."""
    users = F.filter("messages", lambda m: m["role"] == "user")
    parts = F.flatten(F.transform(users, _parts))
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: X.strip(F.coalesce(p["text"], F.lit(""))))
    images = F.transform(
        F.filter(parts, lambda p: p["type"] == "image_url"), lambda p: F.coalesce(p["image_url"]["url"], F.lit(""))
    )
    answers = F.filter(
        "messages",
        lambda m: (m["role"] == "assistant") & ~F.coalesce(F.rlike(m["content"], F.lit(r'^\s*\[\s*\{')), F.lit(True)),
    )
    return rows.select(
        F.col("post_id").alias("sample_id"),
        F.array_join(F.filter(texts, lambda t: F.length(t) > 0), "\n").alias("question"),
        F.coalesce(F.element_at(F.transform(answers, lambda m: m["content"]), -1), F.lit("")).alias("reference"),
        images.alias("images"),
    )


def assemble(turns: DataFrame, sample: str, turn: str, role: str, text: str) -> DataFrame:
    """Same, from one row per turn: user texts joined in order, last answer kept.

    The answer is a ``max_by``; the question is joined block by block of turns.
    """
    reference = turns.groupBy(sample).agg(
        F.max_by(text, F.when(F.col(role) == "assistant", F.col(turn))).alias("_last"),
        F.max(F.when(F.col(role) == "assistant", 1)).alias("_has"),
        F.count_if((F.col(role) == "user") & (F.length(X.strip(F.col(text))) > 0)).alias("question_parts"),
    )
    asked = (
        turns.filter(F.col(role) == "user")
        .select(sample, turn, X.strip(F.col(text)).alias("_t"))
        .filter(F.length("_t") > 0)
    )
    block = F.floor(F.col(turn) / TURN_BLOCK)
    question = ordered_text(asked, [sample], turn, block, "_t", "\n", "question")
    return reference.join(question, sample, "left").select(
        sample,
        F.coalesce("question", F.lit("")).alias("question"),
        F.when(F.col("_has") == 1, F.col("_last")).otherwise(F.lit("")).alias("reference"),
        "question_parts",
    )


def validate(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Totals of a parsed dataset."""
    per_id = samples.groupBy(sample).agg(
        F.count("*").alias("_n"),
        F.count_if(F.length("question") == 0).alias("_noq"),
        F.count_if(F.length("reference") == 0).alias("_nor"),
    )
    return per_id.agg(
        F.sum("_n").alias("total_samples"),
        F.count("*").alias("unique_samples"),
        F.count_if(F.col("_n") > 1).alias("duplicate_samples"),
        F.sum("_noq").alias("missing_question"),
        F.sum("_nor").alias("missing_reference"),
    )


def validation_ids(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(problem, id) of what ``validate`` counts, each once: duplicate, missing_question, missing_reference.  All ids, not the first few."""
    per_id = samples.groupBy(F.col(sample).alias("id")).agg(
        (F.count("*") > 1).alias("duplicate"),
        F.bool_or(F.length("question") == 0).alias("missing_question"),
        F.bool_or(F.length("reference") == 0).alias("missing_reference"),
    )
    names = ("duplicate", "missing_question", "missing_reference")
    found = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return per_id.select(F.explode(found).alias("problem"), "id")
