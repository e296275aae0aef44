"""Helpers shared by the corpus operators: scratch tables and zero-copy Arrow views."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.runtime import scratch

#: Bytes of text that one NumPy step handles at a time, so that memory doesn't follow the batch size.
BLOCK_BYTES = 1 << 20


#: Whether Spark deletes a query's shuffle files as soon as it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: lost executors recompute nothing above it, and the
    shuffle files of the writing query go at once."""
    spark = df.sparkSession
    path, usual = scratch(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, usual)
    return spark.read.schema(df.schema).parquet(path)


def scaled_partitions(spark: SparkSession, least: int = 8) -> int:
    """Number of shuffle partitions of the session, which is set in proportion to the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key is hot if it has more than this share of the rows, so that there are at most so many hot keys.
HOT_KEYS = 4096


def looked_up(rows: DataFrame, values: DataFrame, key: str, n_rows: int, counted: str) -> DataFrame:
    """rows with the columns of `values`, which has each key once and, in `counted`, how many rows have it.

    Keys with over n_rows / HOT_KEYS rows are fewer than HOT_KEYS whatever the table's size; their values are
    broadcast, and the rows of all other keys are dealt by key. Rows of a key without a value have nulls. `rows` is
    read twice, so it ought to be a written table.
    """
    hot = values.where(F.col(counted) * HOT_KEYS > n_rows).drop(counted).withColumn("_hot", F.lit(True))
    names = [c for c in values.columns if c not in (key, counted)]
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.where("_hot is null").drop("_hot", *names).hint("merge").join(values.where(F.col(counted) * HOT_KEYS <= n_rows).drop(counted), key, "left")
    return marked.where("_hot").drop("_hot").unionByName(cold)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and data of a binary or string array, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row is a range of its own. After the last one freed memory is
    given back."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    trim()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of `sizes[i]` each, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers that spreads every input bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def trim() -> None:
    """Gives freed memory of this worker back to the system, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
