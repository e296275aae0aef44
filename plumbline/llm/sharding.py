"""Reproducible shuffle into shards: a Feistel network with cycle walking permutes global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import mixed


class Feistel:
    """A keyed permutation of 0 to n-1. Values are permuted in the least even-bit range that holds n, and again
    while they fall outside n (cycle walking), which always ends since a permutation's cycles are closed."""

    def __init__(self, n: int, seed: int = 0, rounds: int = 6):
        if n < 1:
            raise ValueError("n must be positive")
        self.n = n
        self.half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) + mixed(np.array([seed & (1 << 64) - 1], np.uint64)))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & self.mask)
        return right << self.half | left  # halves change places at the end, so that reversed keys undo it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), keys)
        while (far := np.nonzero(out >= np.uint64(self.n))[0]).size:
            out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, self.keys)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self.keys[::-1])

    def locate(self, row: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers, without any table."""
        p = self.place(row)
        return p % shards, p // shards

    def row_at(self, shard: np.ndarray, slot: np.ndarray, shards: int) -> np.ndarray:
        return self.row(np.asarray(slot) * shards + np.asarray(shard))


def numbered(rows: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """Adds row_number (0 to n-1) and n_rows. Rows are dealt to a fixed number of buckets by a hash of the keys and
    counted there; a bucket's first number is the running sum over at most `buckets` counts. The same rows get the
    same numbers however they are partitioned; rows with equal keys are interchangeable. One shuffle of the rows."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    total = Window.partitionBy(F.lit(0))
    bases = counts.select("_bucket", (F.sum("_n").over(total.orderBy("_bucket")) - F.col("_n")).alias("_base"), F.sum("_n").over(total).alias("n_rows"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)) - 1)
    return ranked.join(F.broadcast(bases), "_bucket").withColumn("row_number", F.col("_base") + F.col("_rank")).drop("_bucket", "_base", "_rank")


def permuted(row: Column, n: Column, seed: int = 0) -> Column:
    """Place of a row number under the permutation of its table's size."""

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[int, Feistel] = {}
        for rows, sizes in batches:
            out = np.empty(len(rows), np.int64)
            for size in np.unique(sizes):
                at = (sizes == size).to_numpy()
                out[at] = made.setdefault(int(size), Feistel(int(size), seed)).place(rows.to_numpy()[at])
            yield pd.Series(out)

    return place(row, n)


def shard(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number): law `rows`.

    Shard sizes are at most one row apart whatever the texts are, so copies and long documents are spread evenly.
    Texts are not shuffled, only their id, size and checksum. A null text has size 1 and the checksum of no bytes;
    a null id is numbered like any other. Repeated rows each get a place of their own; which of them has which is
    arbitrary. Texts of any length count by size and checksum alone. Empty input gives no rows. Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    placed = numbered(rows, ["doc_id", "_hash", "size"]).withColumn("_place", permuted(F.col("row_number"), F.col("n_rows"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_place div {int(shards)}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
