"""Registered queries of the dealt operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, interactions, jaccard, minhash, mixing, neighbours, packing, personal, repeats, secrets, sql, toxicity, vector_codes
from . import quality as quality_model


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.document_shares(_docs(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(_docs(spark, sf))


def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.quality(_docs(spark, sf), _labels(spark, sf))


def op5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(_docs(spark, sf))


def op7_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal.scan(_docs(spark, sf))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf), _labels(spark, sf))


def op9_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.removed(_docs(spark, sf))


def op10_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_docs(spark, sf))


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return interactions.filter_audit(_docs(spark, sf), _labels(spark, sf))


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.encode(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.join(_docs(spark, sf))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_fingerprints": op2_fingerprints,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_neighbours": op5_neighbours,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_repeats": op9_repeats,
    "op10_pack": op10_pack,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_near_duplicates": op13_near_duplicates,
}

# The others hash, learn or tokenize, which SQL cannot say the same way; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op6_jaccard_join": sql.near_duplicates(90, kept=False),
    "op11_filter_audit": sql.FILTER_AUDIT,
    "op12_vector_codes": sql.VECTOR_CODES,
    "op13_near_duplicates": sql.near_duplicates(85, kept=True),
}
