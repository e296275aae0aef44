"""Detectors over centred windows, clipped at the ends of a series.

Each adds `is_anomaly` and `clean` (the window's median where a point is flagged, else the point). A missing point
is never flagged and stays missing; missing neighbours are left out of the windows. Standard deviations are those
of the population and quantiles interpolate. Windows that are too small leave the point alone.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from plumbline.functions import arrays as A
from plumbline.functions import rolling as R
from plumbline.functions.windows import Series, values

MAD_SCALE, IQR_SCALE = 1.4826, 1.349


@cache
def chauvenet_cut(n: int) -> float:
    """The distance d in standard deviations at which n * erfc(d / sqrt 2) is one half, by bisection."""
    low, high = 0.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if n * math.erfc(middle / math.sqrt(2)) > 0.5 else (low, middle)
    return (low + high) / 2


def _finish(df: DataFrame, flag: Column, replacement: Column, drop: list[str]) -> DataFrame:
    flagged = F.coalesce(flag, F.lit(False)) & F.col("x").isNotNull()
    return df.withColumn("is_anomaly", flagged).withColumn("clean", F.when(F.col("is_anomaly"), replacement).otherwise(F.col("x"))).drop(*drop)


def rolling_median(s: Series, radius: int = 2) -> DataFrame:
    return s.df.withColumn("med", F.percentile("x", F.lit(0.5)).over(s.frame(radius, radius)))


def chauvenet(s: Series, radius: int = 10) -> DataFrame:
    over = s.frame(radius, radius)
    df = s.df.select("*", F.avg("x").over(over).alias("_m"), F.stddev_pop("x").over(over).alias("_s"), F.count("x").over(over).alias("_n"), F.percentile("x", F.lit(0.5)).over(over).alias("_med"))
    cuts = F.array(*[F.lit(chauvenet_cut(n)) for n in range(3, 2 * radius + 2)])
    flag = (F.col("_n") >= 3) & (F.col("_s") >= 1e-12) & (F.abs(F.col("x") - F.col("_m")) > F.get(cuts, F.col("_n").cast("int") - 3) * F.col("_s"))
    return _finish(df, flag, F.col("_med"), ["_m", "_s", "_n", "_med"])


def tukey(s: Series, radius: int = 10, k: float = 1.5) -> DataFrame:
    over = s.frame(radius, radius)
    df = s.df.select("*", F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(over).alias("_q"), F.count("x").over(over).alias("_n"))
    q1, med, q3 = (F.get("_q", F.lit(i)) for i in range(3))
    spread = k * (q3 - q1)
    flag = (F.col("_n") >= 4) & ((F.col("x") < q1 - spread) | (F.col("x") > q3 + spread))
    return _finish(df, flag, med, ["_q", "_n"])


def hampel(s: Series, radius: int = 10, n_sigmas: float = 3.0) -> DataFrame:
    df = s.df.withColumn("_w", values(s.frame(radius, radius)))
    df = df.withColumn("_med", A.median(F.col("_w")))
    df = df.withColumn("_mad", MAD_SCALE * A.median(A.deviations(F.col("_w"), F.col("_med"))))
    off = F.abs(F.col("x") - F.col("_med"))
    flag = (F.size("_w") >= 3) & F.when(F.col("_mad") < 1e-12, off > 1e-9).otherwise(off > n_sigmas * F.col("_mad"))
    return _finish(df, flag, F.col("_med"), ["_w", "_med", "_mad"])


def sigma_clip(s: Series, radius: int = 10, n_sigmas: float = 3.0, rounds: int = 5) -> DataFrame:
    """The point itself isn't in its window, so it can't hide by widening the spread."""
    df = s.df.withColumn("_nb", F.concat(values(s.frame(radius, -1)), values(s.frame(-1, radius))))
    df = df.withColumn("_kept", A.clipped(F.col("_nb"), n_sigmas, rounds))
    df = df.withColumn("_m", A.mean(F.col("_kept"))).withColumn("_s", A.std(F.col("_kept")))
    off = F.abs(F.col("x") - F.col("_m"))
    flag = (F.size("_nb") >= 3) & F.when(F.col("_s") < 1e-12, off > 1e-9).otherwise(off > n_sigmas * F.col("_s"))
    return _finish(df, flag, A.median(F.col("_kept")), ["_nb", "_kept", "_m", "_s"])


def pressure(s: Series, radius: int = 10, threshold: float = 8.0, n_sigmas: float = 3.0, wide: int = 3, spring: float = 3.0) -> DataFrame:
    """Up to four pairs of centre and scale, weighted by inverse variance, give `pressure`; it is held against
    `eff_threshold`, which rises where the near window differs from the one `wide` times as far.

    Each window is sorted once and all its statistics are read from it, in one pass over Arrow batches.
    """
    out = StructType([StructField("pressure", DoubleType()), StructField("eff_threshold", DoubleType()), StructField("is_anomaly", BooleanType()), StructField("clean", DoubleType())])

    def compute(x: np.ndarray, series: np.ndarray, begin: int, end: int) -> list[pa.Array]:
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            w, far = R.windows(x, series, begin, end, radius), R.windows(x, series, begin, end, radius * wide)
            own, around = x[begin:end], np.delete(w, radius, 1)
            n, mean, std = R.moments(w)
            ordered = np.sort(w, 1)
            med = R.quantile(ordered, n, 0.5)
            mad = MAD_SCALE * R.quantile(np.sort(np.abs(w - med[:, None]), 1), n, 0.5)
            kept = around.copy()
            for _ in range(5):
                k, m, sd = R.moments(kept)
                cut = (k >= 2) & (sd >= 1e-12)
                kept = np.where(cut[:, None], np.where(np.abs(around - m[:, None]) <= n_sigmas * sd[:, None], around, np.nan), kept)
            _, m, sd = R.moments(kept)
            sd[(~np.isnan(around)).sum(1) < 3] = np.nan
            centres = np.stack([mean, med, med, m], 1)
            scales = np.stack([std, (R.quantile(ordered, n, 0.75) - R.quantile(ordered, n, 0.25)) / IQR_SCALE, mad, sd], 1)
            weights = np.where(scales > 1e-12, 1 / scales**2, 0)
            total = weights.sum(1)
            usable = (n >= 4) & ~np.isnan(own) & (total > 0)
            centre = np.where(weights > 0, centres * weights, 0).sum(1) / total
            held = np.where(usable, np.abs(own - centre) * np.sqrt(total), 0.0)
            raised = np.where(usable, threshold * (1 + spring * _jensen_shannon(w, far)), threshold)
            flag = held > raised
            clean = np.where(flag, med, own)
        return [pa.array(held), pa.array(raised), pa.array(flag), pa.array(clean, mask=np.isnan(clean))]

    return R.streamed(s, radius * wide, out, compute)


def _jensen_shannon(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """arrays.jensen_shannon for rows of two matrices; NaN isn't there."""
    both = np.concatenate([a, b], 1)
    inside = ~np.isnan(both)
    low, high = np.where(inside, both, np.inf).min(1), np.where(inside, both, -np.inf).max(1)
    bins = np.clip(inside.sum(1) // 6, 3, 10)
    step = (high - low) / bins
    # no bin holds anything where the range is beyond a double
    flat = ~(high - low >= 1e-12) | np.isinf(high - low)

    def shares(w: np.ndarray) -> np.ndarray:
        # values at or above the lower edge of each bin, and from these those within
        above = np.stack([(~np.isnan(w)).sum(1), *[np.where(k < bins, (w >= (low + k * step)[:, None]).sum(1), 0) for k in range(1, 10)], np.zeros(len(w), int)], 1)
        counts = np.where(np.arange(10) < bins[:, None], above[:, :-1] - above[:, 1:] + 1.0, 0)
        return counts / counts.sum(1, keepdims=True)

    p, q = shares(a), shares(b)
    m = np.where(p + q > 0, 0.5 * (p + q), 1)
    terms = 0.5 * np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / m), 0) + 0.5 * np.where(q > 0, q * np.log2(np.where(q > 0, q, 1) / m), 0)
    return np.where(flat, 0.0, terms.sum(1))


def divergence(s: Series, radius: int = 10, wide: int = 3) -> DataFrame:
    """Adds `jsd`: how much the near window differs from the wide one, in bits; 0 for windows of fewer than 4."""

    def compute(x: np.ndarray, series: np.ndarray, begin: int, end: int) -> list[pa.Array]:
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            w, far = R.windows(x, series, begin, end, radius), R.windows(x, series, begin, end, radius * wide)
            return [pa.array(np.where((~np.isnan(w)).sum(1) >= 4, _jensen_shannon(w, far), 0.0))]

    return R.streamed(s, radius * wide, StructType([StructField("jsd", DoubleType())]), compute)


def heal(s: Series, radius: int = 2, sustain: float = 0.7, wide: int = 3) -> DataFrame:
    """A departure from the wide median stays only if most of the near window goes as far to the same side."""
    df = s.df.select("*", F.percentile("x", F.lit(0.5)).over(s.frame(radius * wide, radius * wide)).alias("_med"), values(s.frame(radius, radius)).alias("_w"))
    off = F.col("x") - F.col("_med")
    along = F.size(F.filter("_w", lambda v: (F.signum(v - F.col("_med")) == F.signum(off)) & (F.abs(v - F.col("_med")) > sustain * F.abs(off))))
    keep = (F.abs(off) < 1e-9) | (along * 2 > F.size("_w"))
    df = df.withColumn("clean", F.when(F.col("x").isNull() | keep, F.col("x")).otherwise(F.col("_med")))
    return df.withColumn("is_anomaly", F.coalesce(F.col("clean") != F.col("x"), F.lit(False))).drop("_med", "_w")
