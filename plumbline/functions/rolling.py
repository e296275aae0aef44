"""Centred windows as NumPy matrices over Arrow batches, for operators with many statistics of one window.

Series are sorted within partitions by Spark; a task reads its rows once, as a stream, and holds no more than a batch
and the windows' reach on either side, however long a series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.windows import Series

#: Rows whose windows are one matrix.
ROWS = 4096


def windows(x: np.ndarray, series: np.ndarray, begin: int, end: int, radius: int) -> np.ndarray:
    """Rows of 2 * radius + 1 values around the points begin to end - 1; NaN outside of a point's series."""
    padded = np.concatenate([np.full(radius, np.nan), x, np.full(radius, np.nan)])
    owner = np.concatenate([np.full(radius, -1), series, np.full(radius, -1)])
    of = np.lib.stride_tricks.sliding_window_view
    return np.where(of(owner, 2 * radius + 1)[begin:end] == series[begin:end, None], of(padded, 2 * radius + 1)[begin:end], np.nan)


def quantile(ordered: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """By linear interpolation between the first n values of each row; NaN for none."""
    at = np.maximum(n - 1, 0) * q
    low = np.floor(at).astype(int)
    rows = np.arange(len(n))
    first, second = ordered[rows, low], ordered[rows, np.minimum(low + 1, np.maximum(n - 1, 0))]
    return first + (at - low) * (second - first)


def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population standard deviation of each row's numbers; NaN for none."""
    inside = ~np.isnan(w)
    n = inside.sum(1)
    some = np.where(n > 0, n, np.nan)
    mean = np.where(inside, w, 0).sum(1) / some
    return n, mean, np.sqrt((np.where(inside, w - mean[:, None], 0) ** 2).sum(1) / some)


def streamed(s: Series, reach: int, out: StructType, compute: Callable[[np.ndarray, np.ndarray, int, int], list[pa.Array]]) -> DataFrame:
    """The rows with the columns of `out` after their own. compute(x, series, begin, end) gives these for the points
    begin to end - 1 of x (NaN: missing), which has `reach` points more on either side where there are any."""
    df = s.df.withColumn("_at", F.row_number().over(s.window()))
    names = [*s.df.columns, *out.names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, series, done, until, _ in held_rows(batches, reach):
            for i in range(done, until, ROWS):
                j = min(until, i + ROWS)
                a, b = max(0, i - reach), min(len(x), j + reach)
                mine = rows.slice(i, j - i).drop_columns(["_at"]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*mine.columns, *compute(x[a:b], series[a:b], i - a, j - a)], names)

    return df.mapInArrow(run, StructType([*s.df.schema.fields, *out.fields]))


def held_rows(batches: Iterable[pa.RecordBatch], reach: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, int, int, list]]:
    """Sorted rows as (rows, x, number of the series, begin, end, kept): the points begin to end - 1 are due, and have
    `reach` points more on either side where there are any. `kept` is the caller's, one list for all steps."""
    held, done, waiting, size, kept = None, 0, [], 0, []
    for batch in chain(batches, [None]):
        if batch is not None:
            waiting.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < ROWS:
                continue
        parts = [*([held] if held is not None else []), *waiting]
        if not parts:
            return
        held, waiting, size = pa.concat_tables(parts).combine_chunks(), [], 0
        x = held.column("x").to_numpy(zero_copy_only=False).astype(float)
        series = np.cumsum(held.column("_at").to_numpy() == 1)
        until = held.num_rows if batch is None else max(done, held.num_rows - reach)
        yield held, x, series, done, until, kept
        start = max(0, until - reach)
        held, done = held.slice(start), until - start
