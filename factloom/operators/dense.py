"""Dense retrieval over stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import top_k

# Largest set of query vectors handed to every task (rows x dimensions x 8 bytes).
MAX_QUERY_BYTES = 64 << 20
MAX_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def clamp01(col: Column) -> Column:
    # greatest and least skip NULL, so a missing score must stay missing here
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col)))


def nearest(vectors: DataFrame, vec_id: str, embedding: str, query: list[float], k: int) -> DataFrame:
    """Best ``k`` vectors for one query: one scan and a top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(vec_id, F.round(dot(F.col(embedding), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), vec_id).limit(k)


def centroids(vectors: DataFrame, label: str, embedding: str) -> DataFrame:
    """Mean vector per label."""
    per_dim = (
        vectors.select(label, F.posexplode(embedding).alias("dim", "x"))
        .groupBy(label, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return per_dim.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: F.round(s["x"], 9)).alias("centroid")
    )


def nearest_batch(
    vectors: DataFrame, vec_id: str, embedding: str, queries: DataFrame, query_id: str, query_vec: str, k: int
) -> DataFrame:
    """Best ``k`` vectors for each row of ``queries``.

    Query vectors are sent to the tasks in blocks whose size is checked; more
    queries mean more blocks (scans), never a larger one.  Every Arrow batch is
    scored with one matrix product and only its best ``k`` per query leave the
    task.
    """
    rows: Iterator = queries.select(query_id, query_vec).orderBy(query_id).toLocalIterator()
    parts: list[DataFrame] = []
    block: list = []

    def scan(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        matrix = np.array([r[1] for r in block], dtype="float64").T
        id_type = queries.schema[query_id].dataType.simpleString()
        vec_type = vectors.schema[vec_id].dataType.simpleString()

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                found = np.round(np.stack(pdf["e"].to_numpy()).astype("float64") @ matrix, 6)
                names = pdf["v"].to_numpy()
                for j, qid in enumerate(ids):
                    best = np.lexsort((names, -found[:, j]))[:k]
                    yield pd.DataFrame({query_id: qid, vec_id: names[best], "score": found[best, j]})

        schema = f"`{query_id}` {id_type}, `{vec_id}` {vec_type}, score double"
        return vectors.select(F.col(vec_id).alias("v"), F.col(embedding).alias("e")).mapInPandas(score, schema)

    used = 0
    for row in rows:
        size = len(row[1]) * 8
        if block and (used + size > MAX_QUERY_BYTES or len(block) >= MAX_QUERIES):
            parts.append(scan(block))
            block, used = [], 0
        block.append(row)
        used += size
    if block or not parts:
        parts.append(scan(block))
    local = parts[0]
    for part in parts[1:]:
        local = local.unionByName(part)
    return top_k(local, [query_id], [F.desc("score"), F.col(vec_id)], k)


def encode(chunks: DataFrame, chunk_id: str, body: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """Build a dense index with a caller-supplied encoder, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = np.asarray(encoder([t or "" for t in part["t"]]), dtype="float32")
                yield pd.DataFrame({chunk_id: part["c"].to_numpy(), "embedding": list(vectors)})

    kind = chunks.schema[chunk_id].dataType.simpleString()
    return chunks.select(F.col(chunk_id).alias("c"), F.col(body).alias("t")).mapInPandas(
        run, f"`{chunk_id}` {kind}, embedding array<float>"
    )


def index_status(vectors: DataFrame, embedding: str, chunks: DataFrame | None = None) -> DataFrame:
    """One health row: row count, dimensions seen and whether it can be used."""
    base = vectors.agg(
        F.count("*").alias("vectors"),
        F.min(F.size(embedding)).alias("min_dim"),
        F.max(F.size(embedding)).alias("max_dim"),
        F.count_if(F.col(embedding).isNull()).alias("missing"),
    )
    usable = (F.col("vectors") > 0) & (F.col("missing") == 0) & (F.col("min_dim") == F.col("max_dim"))
    if chunks is not None:
        return base.withColumn("chunks", chunks.agg(F.count("*")).scalar()).withColumn(
            "usable", usable & (F.col("chunks") > 0)
        )
    return base.withColumn("usable", usable)
