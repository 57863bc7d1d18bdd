"""Bounded samples of rows to learn from.  The bound is the caller's documented parameter."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """text and label of at most ``most`` labelled rows that are not held out, the first by hash of the key.

    ``held_out`` is a condition on the labels' key; a null key or label takes no
    part.  Half of the bound is for each of the two classes, so that a rare one is
    learned.  The chosen keys are few, by the bound, and are broadcast.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out)
    usable = usable.select(F.col(key).alias("chosen"), F.col(label).cast("int").alias("label")).dropDuplicates(["chosen"])
    order = (F.xxhash64("chosen"), F.col("chosen"))
    classes = [usable.where(F.col("label") == c).orderBy(*order).limit(most // 2) for c in (0, 1)]
    chosen = classes[0].union(classes[1])
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "text", "label")


def marked_texts(docs: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text of every row, and whether it is one of about ``most`` rows chosen by hash of the key (all of a smaller table)."""
    share = max(1, docs.count() // most)
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0).alias("sampled"))


class Least:
    """Of each kind the ``most`` distinct examples of the least hash, whatever the order they come in; holds twice as many at most."""

    def __init__(self, most: int):
        self.most = most
        self.kinds: dict[str, dict[tuple, int]] = defaultdict(dict)

    def add(self, kind: str, example: tuple) -> None:
        own = self.kinds[kind]
        if example not in own:
            raw = repr(example).encode("utf-8", "surrogatepass")
            own[example] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)
            if len(own) > 2 * self.most:
                self.kinds[kind] = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[: self.most])

    def __iter__(self) -> Iterator[tuple]:
        """(kind, hash, *example)"""
        for kind, own in self.kinds.items():
            for example, rank in sorted(own.items(), key=lambda x: (x[1], x[0]))[: self.most]:
                yield (kind, rank, *example)
