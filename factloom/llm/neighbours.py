"""Approximate nearest neighbours: a forest of hash prefixes.

Every vector gets one long bit string per tree (signs of projections on fixed
random directions); a tree is the sorted array of its strings.  A query descends
each tree to its longest matching prefix, and then all trees ascend together, one
bit at a time, until the places under the prefixes hold enough candidates.  The
candidates' inner products are then computed exactly on the original vectors.

Largest inner product is turned into smallest angle by one more component that
gives all vectors the same length (and is zero for queries).

The rows are dealt into blocks by hash, each small enough for one task, with a
forest of its own; each block of queries meets each block of rows, keeps its
best there, and the best of all blocks are merged.  Work grows with queries times
rows, memory with a block.  The trees ascend until ``share`` of a block is found:
vectors without structure need that much for a recall above 0.9, which the tests
measure against brute force; clustered ones do with less.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite
components takes no part, nor does one whose length differs from the most common
one's; repeated vectors are kept (ties go to the smaller id); a query is not its own
candidate (rows of equal id count as itself); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
TREES = 48
BITS = 24
SHARE = 0.6
SEED = 29


def directions(size: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, trees * bits)).astype(np.float32)


def bit_strings(vectors: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """One integer of ``bits`` bits per vector and tree, first bit highest."""
    signs = (vectors.astype(np.float32) @ directions(vectors.shape[1], trees, bits, seed) > 0).reshape(len(vectors), trees, bits)
    return signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


class Forest:
    """Sorted bit strings of every tree over one block of rows."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        lengths = np.sqrt((vectors**2).sum(1))
        lift = np.sqrt(np.maximum(lengths.max() ** 2 - lengths**2, 0))
        self.bits, self.trees, self.seed = bits, trees, seed
        strings = bit_strings(np.column_stack([vectors, lift]), trees, bits, seed)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end (depth, query, tree) of the places that share each number of leading bits with the query."""
        strings = bit_strings(np.column_stack([queries, np.zeros(len(queries))]), self.trees, self.bits, self.seed)
        begin = np.empty((self.bits + 1, *strings.shape), np.int32)
        end = np.empty_like(begin)
        for depth in range(self.bits + 1):
            low = (strings >> (self.bits - depth)) << (self.bits - depth)
            for tree in range(self.trees):
                begin[depth, :, tree] = np.searchsorted(self.sorted[:, tree], low[:, tree])
                end[depth, :, tree] = np.searchsorted(self.sorted[:, tree], low[:, tree] + (1 << (self.bits - depth)))
        return begin, end

    def candidates(self, queries: np.ndarray, least: int):
        """For each query, the rows found by ascending all trees together until ``least`` distinct ones are there."""
        begin, end = self.ranges(queries)
        widths = (end - begin).sum(2)
        n = len(self.order)
        for q in range(len(queries)):
            # distinct rows are no more than places, so start at the deepest level with enough places
            depth = int(np.flatnonzero(widths[:, q] >= min(least, n)).max())
            while True:
                found = np.zeros(n, bool)
                for tree in range(self.trees):
                    found[self.order[begin[depth, q, tree] : end[depth, q, tree], tree]] = True
                if depth == 0 or np.count_nonzero(found) >= least:
                    break
                depth -= 1
            yield np.flatnonzero(found)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector (doubles) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def search(vectors: DataFrame, every: int = 20, k: int = 20, share: float = SHARE, key: str = "vec_id", vector: str = "embedding",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each row whose key is divisible by ``every``."""
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim, total = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("vector") == dim)
    blocks = max(1, -(-total // block_rows))
    query_blocks = max(1, -(-total // (every * block_rows)))
    cell = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vector", cell(1, query_blocks).alias("qb")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = rows.select("vec_id", "vector", cell(2, blocks).alias("b")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(points):
            return empty
        q, x = np.stack(queries["vector"].to_numpy()), np.stack(points["vector"].to_numpy())
        q_ids, x_ids = queries["vec_id"].to_numpy(), points["vec_id"].to_numpy()
        found = []
        forest = Forest(x)
        for i, near in enumerate(forest.candidates(q, max(4 * k, int(share * len(x))))):
            near = near[x_ids[near] != q_ids[i]]
            # row sums, not a matrix product: equal vectors then have equal scores
            scores = (x[near] * q[i]).sum(1)
            if len(near) > k:
                top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                near, scores = near[top], scores[top]
            best = np.lexsort((x_ids[near], -scores))[:k]
            found.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": x_ids[near][best], "score": scores[best]}))
        return pd.concat(found) if found else empty

    met = asked.groupBy("qb", "b").cogroup(given.groupBy("qb", "b")).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
