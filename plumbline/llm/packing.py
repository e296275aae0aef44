"""Concatenate and cut: token counts of partitions are summed up in a first pass, which gives every document its
global offset; the second pass cuts at fixed window borders and writes one record per piece."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import encoded_blocks, packed, tokenizer
from plumbline.llm.common import as_bytes, blocks, spread, written

#: Partitions of the first pass (16 bytes each) up to which their offsets are broadcast; a join is used beyond.
BROADCAST_ROWS = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _counted(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """First pass: packed ids with the end id, and where each document starts within its partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        width = "<u2" if tokenizer(path).size <= 1 << 16 else "<u4"
        for batch in batches:
            for i, ids, at in encoded_blocks(batch, "t", path):
                ids, n = np.insert(ids.astype(width), at[1:], end_id), np.diff(at) + 1
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int64()), pa.array(first + at[:-1]), pa.array(n), batch.column("d").slice(i, len(n)), packed(ids, at)], ["part", "local_start", "n", "d", "ids"])
                first += int(at[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "part long, local_start long, n long, d long, ids binary")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document in a sequence of `window` tokens; only the last sequence is not full.

    A null or empty text is its end id alone, as a piece of length 1. Every id is in exactly one piece. Which
    documents are neighbours follows the partitions read; the packed ids are written once to the shared folder, so
    that both passes and every retry see the same offsets. Empty input gives no rows. Repeated rows are packed as
    often as they come; other columns are ignored.
    """
    if window < 1:
        raise ValueError("window must be positive")
    counted = written(_counted(docs, path, end_id), "packing")
    totals = counted.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each partition of the first pass
    bases = written(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "bases")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype("<u2" if tokenizer(path).size <= 1 << 16 else "<u4")
        for batch in batches:
            at, data = as_bytes(batch.column("ids"))
            for i, j in blocks(at):
                ids = np.frombuffer(data[at[i] : at[j]].tobytes(), width).astype("<u4")
                begin, n = (batch.column(c).slice(i, j - i).to_numpy() for c in ("begin", "n"))
                # the windows that a document touches, one piece in each
                window_of = begin // window
                pieces = (begin + n - 1) // window - window_of + 1
                doc = np.repeat(np.arange(j - i), pieces)
                sequence = spread(window_of, pieces)
                place = np.maximum(sequence * window, begin[doc])
                start = place - begin[doc]
                size = np.minimum((sequence + 1) * window, (begin + n)[doc]) - place
                raw, here = memoryview(ids.tobytes()), start + ((at[i:j] - at[i]) // width.itemsize)[doc]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(here.tolist(), (here + size).tolist(), strict=True)]
                columns = (batch.column("d").slice(i, j - i).take(pa.array(doc)), start, size, crc, n[doc], sequence, place % window)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = counted.join(bases, "part").select("d", (F.col("base") + F.col("local_start")).alias("begin"), "n", "ids")
    return placed.mapInArrow(run, PIECES)
