"""Recursive adaptive filter: a true recurrence, so each series or grid is folded in order.

Series are dealt to tasks by key; within a task all its series advance together, one NumPy step per position, so the
cost of Python is per position and not per point. State is three numbers a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.elementwise import ALPHA, C_ANOMALY, EPS, GAIN_HIGH, GAIN_LOW, K_MAX, SIGMA
from plumbline.functions.windows import Series, with_double


@dataclass(frozen=True)
class Stabilizer:
    """The filter's parameters; `threshold` is always given, none is kept from earlier calls."""

    threshold: float = 1e-5
    alpha: float = SIGMA
    sigma_mult: float = 2.0
    k_min: float = 0.25
    k_max: float = K_MAX
    radius: int = 1
    blend: float = 0.5


#: Parameter sets for known kinds of signal.
PRESETS: dict[str, Stabilizer] = {
    "balanced_v2": Stabilizer(1e-05, 0.05, 1.0, 0.18, 0.28),
    "cifar10_best_v1": Stabilizer(4.384205263047182e-06, 0.04590571010729771, 0.8, 0.19814386535420334, 0.2945784399322787),
    "pure_1d_time_v1": Stabilizer(0.08, 0.35, 1.2, 0.25, 0.55),
    "cifar10_hardened_lyapunov": Stabilizer(0.12, 0.05, 1.0, 0.18, 0.28),
}


def step(p, vol, m, x, conf: Stabilizer, threshold, hard=False, left=None, up=None):
    """One position of many series at once: new output, volatility and local mean. NaN in x is a missing value, and a
    neighbour that is missing counts as the last output."""
    missing = np.isnan(x)
    x = np.where(missing, p, x)
    d = np.abs(x - p)
    if left is None:
        diff, coherence = d, np.clip(1 - d / 2, 0, 1)
    else:
        dl, du = np.abs(x - np.where(np.isnan(left), p, left)), np.abs(x - np.where(np.isnan(up), p, up))
        diff = d / 2 + dl / 4 + du / 4
        coherence = np.clip(0.4 * (1 - d / 2) + 0.3 * (1 - dl / 2) + 0.3 * (1 - du / 2), 0, 1)
    local = np.clip(1 - np.abs(x - m) / (2 * np.maximum(np.abs(m), 1e-3)), 0, 1)
    vol = (1 - conf.alpha) * vol + conf.alpha * diff
    limit = threshold + conf.sigma_mult * vol
    anomaly = (diff > limit) | missing
    usual = ALPHA + SIGMA
    calm = np.clip((coherence + local) / 2 * usual / (usual + vol + EPS), GAIN_LOW, GAIN_HIGH)
    reach = C_ANOMALY * np.maximum(np.abs(p), 1e-8)
    wild = np.clip(reach / (reach + diff + EPS), np.where(hard, 0.0, conf.k_min), conf.k_max)
    strength = np.where(missing, 1.0, np.clip((diff - limit) / (limit + EPS), 0, 1))
    k = (1 - strength) * calm + strength * wild
    y = (1 - k) * p + k * x
    scale = np.where(anomaly, 0.7 * np.sqrt(p * p + EPS) / (np.sqrt(y * y + EPS) + EPS) + 0.3, 1.0)
    kept = local * y + (1 - local) * y * scale
    out = conf.blend * y + (1 - conf.blend) * kept
    a = 1 / (max(conf.radius, 1) + 1)
    return out, vol, (1 - a) * m + a * out


def scan(x: np.ndarray, conf: Stabilizer, threshold: np.ndarray, from_second: bool = True, hard: np.ndarray | None = None, width: int = 0) -> np.ndarray:
    """Filters rows of series (NaN: missing; padding at the end does no harm). width: of a grid in row-major order."""
    n, t = x.shape
    if not t:
        return x.copy()
    first = np.where(np.isnan(x[:, 0]), 0.0, x[:, 0])
    p, m, vol, out = first, first, np.zeros(n), np.empty_like(x)
    for i in range(t):
        if i == 0 and from_second:
            out[:, 0] = first
            continue
        left = up = None
        if width:
            left, up = x[:, i - 1] if i % width else x[:, i], x[:, i - width] if i >= width else x[:, i]
        p, vol, m = step(p, vol, m, x[:, i], conf, threshold, False if hard is None else hard[:, i], left, up)
        out[:, i] = p
    return out


def calibrate(s: Series, conf: Stabilizer | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., thr, noise_scalar, panic) over points that aren't missing; steps are between neighbours of a series.

    A great lonely jump gives the least threshold; otherwise it is a tenth of the standard deviation, and the
    stabilizer's own if no series has two points.
    """
    conf = conf or Stabilizer()
    df = s.df.withColumn("_d", F.abs(F.col("x") - F.lag("x").over(s.window())))
    grouped = df.groupBy(*by) if by else df.groupBy()
    out = grouped.agg(F.stddev_pop("x").alias("_s"), F.max("_d").alias("_max"), F.avg("_d").alias("_mean"))
    panic = F.coalesce((F.col("_max") > 3) & (F.col("_max") / (F.col("_mean") + 1e-5) > 5), F.lit(False))
    thr = F.when(F.col("_max").isNull(), F.lit(conf.threshold)).when(panic, F.lit(1e-5)).otherwise(0.10 * F.col("_s"))
    return out.select(*by, thr.alias("thr"), (1 / (1 + F.col("_s"))).alias("noise_scalar"), panic.alias("panic"))


def _folded(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], conf: Stabilizer, batch: bool, width: int, tasks: int) -> DataFrame:
    """Adds `filtered`. Series of a task are padded to the longest one, a hundred at a time by length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*key, *order], kind="stable").reset_index(drop=True)
        code = rows.groupby(list(key), sort=False, dropna=False).ngroup().to_numpy()
        start = np.concatenate([[0], np.nonzero(np.diff(code))[0] + 1, [len(code)]])
        size = np.diff(start)
        x, thr = rows["x"].to_numpy(dtype=float, na_value=np.nan), rows["_thr"].to_numpy(dtype=float)
        hard = rows["_hard"].to_numpy(dtype=bool)
        out = np.empty(len(rows))
        by = np.argsort(size, kind="stable")
        for some in np.array_split(by, max(1, len(by) // 100)):
            if len(some):
                shape = (len(some), int(size[some].max()))
                at = start[some][:, None] + np.arange(shape[1])[None]
                inside = np.arange(shape[1])[None] < size[some][:, None]
                at = np.where(inside, at, 0)
                got = scan(np.where(inside, x[at], np.nan), conf, thr[start[some]], not batch, np.where(inside, hard[at], False), width)
                out[at[inside]] = got[inside]
        return rows.assign(filtered=out).drop(columns=["_task"])

    dealt = df.withColumn("_task", F.pmod(F.xxhash64(*key), F.lit(tasks)))
    schema = with_double(df.schema, "filtered")
    return dealt.groupBy("_task").applyInPandas(run, schema).drop("_thr", "_hard")


def _tasks(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stabilize_stream(s: Series, conf: Stabilizer | None = None, threshold: Column | float | None = None, tasks: int | None = None) -> DataFrame:
    """Adds `filtered`: each series from its second point on; the first passes, as 0 if it is missing."""
    conf = conf or Stabilizer()
    thr = threshold if isinstance(threshold, Column) else F.lit(float(conf.threshold if threshold is None else threshold))
    return _folded(s.df.withColumn("_thr", thr).withColumn("_hard", F.lit(False)), s.key, s.order, conf, False, 0, tasks or _tasks(s.df))


def stabilize_batch(s: Series, conf: Stabilizer | None = None, width: int = 0, by: tuple[str, ...] = (), hard: str | None = None, tasks: int | None = None) -> DataFrame:
    """Adds `filtered`, with a threshold calibrated over the whole batch (or each value of `by`).

    width: the series are grids in row-major order, whose left and upper neighbours count. hard: a boolean column of
    points that may be pulled back entirely.
    """
    conf = conf or Stabilizer()
    thr = calibrate(s, conf, by).select(*by, F.col("thr").alias("_thr"))
    df = s.df.join(F.broadcast(thr), list(by)) if by else s.df.crossJoin(F.broadcast(thr))  # one row, or one for each value of `by`
    df = df.withColumn("_hard", F.coalesce(F.col(hard), F.lit(False)) if hard else F.lit(False))
    return _folded(df, s.key, s.order, conf, True, width, tasks or _tasks(s.df))


def fold(series: np.ndarray, conf: Stabilizer | None = None, threshold: float | None = None) -> np.ndarray:
    """One series in the driver, for small inputs and tests."""
    conf = conf or Stabilizer()
    return scan(np.asarray(series, float)[None], conf, np.array([conf.threshold if threshold is None else threshold]))[0]


def simple_damping(s: Series, threshold: float = 0.15, low: float = 0.10, high: float = 0.85, alpha: float = 0.05) -> DataFrame:
    """Adds `damped`: the core of the filter alone. A step above the threshold and the mean of steps so far takes the
    weight `high`, as a missing point does, and any other `low`. The first point passes, as 0 if it is missing."""

    order = list(s.order)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        x, out = rows["x"].to_numpy(dtype=float, na_value=np.nan), np.empty(len(rows))
        p, vol = 0.0 if np.isnan(x[0]) else x[0], 0.0
        for i in range(len(x)):
            missing = np.isnan(x[i])
            d = 0.0 if missing else abs(x[i] - p)
            vol = (1 - alpha) * vol + alpha * d
            if not missing:
                p += (high if d > threshold + vol else low) * (x[i] - p)
            out[i] = p
        return rows.assign(damped=out)

    return s.df.groupBy(*s.key).applyInPandas(run, with_double(s.df.schema, "damped"))


def scenario_states(params: Column, base: float = 0.0, keep: float = 0.95, gain: float = 0.05) -> Column:
    """All states of s <- keep * s + gain * p over an array, by an ordered fold."""
    start = F.struct(F.lit(float(base)).alias("s"), F.array().cast("array<double>").alias("all"))

    def advance(acc: Column, p: Column) -> Column:
        new = keep * acc["s"] + gain * p
        return F.struct(new.alias("s"), F.concat(acc["all"], F.array(new)).alias("all"))

    return F.aggregate(params, start, advance, lambda acc: acc["all"])


def scenarios(s: Series, base: float = 0.0) -> DataFrame:
    """Adds `state`. Long series: a state is computed from its own and the 851 points before it; history before these,
    whose weights sum to 0.95^852 = 2^-63, is cut. Values there of up to about 2^10 times the later ones leave no trace
    in double precision; larger ones would change the last bits, and ones of 2^60 times and more the whole state.
    """
    reach = math.ceil(60 * math.log(2) / -math.log(0.95)) + 40
    df = s.indexed().df
    window = F.collect_list(F.coalesce("x", F.lit(0.0))).over(s.frame(reach, 0))
    seen = F.aggregate(window, F.lit(0.0), lambda a, p: 0.95 * a + 0.05 * p)
    return df.withColumn("state", seen + base * F.pow(F.lit(0.95), (F.col("idx") + 1).cast("double"))).drop("idx")


