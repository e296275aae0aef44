"""One-dimensional shield: each point passes or is replaced, looking only at the raw points before it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions import elementwise as E
from plumbline.functions import rolling as R
from plumbline.functions.windows import Series, with_double

MOST = 20
MAD_SCALE = 1.4826


def _radius(n: Column, radius: int | None) -> Column:
    if radius is not None:
        return F.lit(int(radius))
    return F.when(n < 3, 0).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(3), F.floor(n / 3).cast("int"))))


def fill(s: Series, radius: int | None = None) -> DataFrame:
    """Adds `filled`: a missing point becomes the median of those within the radius that aren't missing, else the
    series' median, else 0. Gaps are filled from left to right, and later ones see earlier fills.

    One pass over Arrow batches of sorted rows, which holds a batch and the radius on either side; only missing points
    are looked at one by one.
    """
    reach = MOST if radius is None else max(int(radius), 3)
    df = s.indexed().df
    df = df.select("*", F.count("*").over(s.whole()).alias("_n"), F.percentile("x", F.lit(0.5)).over(s.whole()).alias("_all"))
    df = df.withColumn("_r", F.greatest(_radius(F.col("_n"), radius), F.lit(3)))
    df = s.having(df).df.withColumn("_at", F.row_number().over(s.window()))
    names = [c for c in df.columns if c not in ("_all", "_at")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, series, done, until, before in R.held_rows(batches, reach):
            r, whole = rows.column("_r").to_numpy(), rows.column("_all").to_numpy(zero_copy_only=False).astype(float)
            y = x.copy()
            y[:done] = before
            for i in np.flatnonzero(np.isnan(x[done:until])) + done:
                some = slice(max(0, i - r[i]), i + r[i] + 1)
                near = y[some][(series[some] == series[i]) & ~np.isnan(y[some])]
                y[i] = np.median(near) if len(near) else 0.0 if np.isnan(whole[i]) else whole[i]
            before[:] = []
            before.extend(y[max(0, until - reach) : until])
            mine = rows.select(names).slice(done, until - done).combine_chunks().to_batches()
            if mine:
                yield pa.RecordBatch.from_arrays([*mine[0].columns, pa.array(y[done:until])], [*names, "filled"])

    return df.mapInArrow(run, with_double(df.select(names).schema, "filled"))


def shield(s: Series, radius: int | None = None, reference: str | None = None) -> DataFrame:
    """Adds `filled`, `trigger` (1: passes) and `shielded` (the window's median, or the reference, where it is 0).

    The first two points of a series pass. `reference`: a column of clean values; a missing one is an error of the
    input and counts as the point itself.
    """
    df = fill(s, radius)
    t = s.having(df)
    most = MOST if radius is None else max(1, int(radius))
    df = df.withColumn("_w", F.collect_list("filled").over(t.frame(most, -1)))
    df = df.select("*", F.lag("filled", 1).over(t.window()).alias("_p1"), F.lag("filled", 2).over(t.window()).alias("_p2"))
    r = _radius(F.col("_n"), radius)
    df = df.withColumn("_w", F.when(F.size("_w") > r, F.slice("_w", F.greatest(F.size("_w") - r + 1, F.lit(1)), r)).otherwise(F.col("_w")))
    w, x = F.col("_w"), F.col("filled")
    base = A.mean(w) if reference is None else F.coalesce(E.finite(F.col(reference)), x)
    steps = F.zip_with(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, a: b - a)
    df = df.withColumn("_b", base).withColumn("_s", F.when(F.size(w) >= 3, F.greatest(A.std(steps), F.lit(1e-6))).otherwise(F.lit(1e-6)))
    phi = E.alignment(x, F.col("_b"), F.col("_p1") - F.col("_p2"), F.col("_s"))
    fired = E.fires(E.drive(F.abs(F.col("_b")), F.abs(x), phi))
    df = df.withColumn("trigger", F.when((F.col("idx") < 2) | (F.size("_w") == 0), 1).otherwise(fired))
    replaced = A.median(w) if reference is None else F.col("_b")
    return df.withColumn("shielded", F.when(F.col("trigger") == 1, x).otherwise(replaced)).drop("_w", "_p1", "_p2", "_b", "_s", "_n", "_r")


@dataclass(frozen=True)
class Shield:
    """level: 1 leaves values as they are and only flags them, 0 replaces them fully. threshold: of deviations; by
    default the mean and two standard deviations of the series'."""

    level: float = 1.0
    threshold: float | None = None
    radius: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "level", min(1.0, max(0.0, float(self.level))))

    def analyze(self, s: Series, reference: str | None = None) -> DataFrame:
        """Adds `k` (1 where the trigger replaces), `clean` and `is_anomaly`, besides the columns of shield()."""
        df = shield(s, self.radius, reference)
        whole = s.whole()
        df = df.withColumn("k", 1 - F.col("trigger")).withColumn("_d", F.abs(F.col("filled") - F.col("shielded")))
        df = df.select("*", F.percentile("x", F.lit(0.5)).over(whole).alias("_med"), F.count("x").over(whole).alias("_n"), F.avg("_d").over(whole).alias("_dm"), F.stddev_pop("_d").over(whole).alias("_ds"))
        df = df.withColumn("_mad", F.percentile(F.abs(F.col("x") - F.col("_med")), F.lit(0.5)).over(whole))
        limit = F.lit(float(self.threshold)) if self.threshold is not None else F.col("_dm") + 2 * F.col("_ds")
        far = F.abs(F.coalesce("x", "_med") - F.col("_med")) / (MAD_SCALE * F.when(F.col("_mad") == 0, F.lit(1e-12)).otherwise(F.col("_mad"))) > 6
        flag = (F.col("_d") > F.greatest(limit, F.lit(1e-12))) | ((F.col("_n") >= 4) & F.coalesce(far, F.lit(False))) | F.col("x").isNull()
        clean = F.col("filled") - F.col("k") * (1 - self.level) * (F.col("filled") - F.col("shielded"))
        return df.withColumn("is_anomaly", flag).withColumn("clean", clean).drop("_d", "_med", "_n", "_dm", "_ds", "_mad")

    def report(self, s: Series, reference: str | None = None) -> DataFrame:
        """One row per series: points, mean of k, anomalies in order, drift, and all of it as `json`. Missing and
        infinite numbers are the text NaN there."""
        rows = self.analyze(s, reference)
        number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
        item = F.struct("idx", number("x").alias("raw"), number("clean").alias("clean"), F.col("k"))
        out = rows.groupBy(*s.key).agg(F.count("*").alias("points"), F.avg("k").alias("mean_k"), F.array_sort(F.collect_list(F.when(F.col("is_anomaly"), item))).alias("anomalies"))
        out = out.join(drift(s), list(s.key)).withColumn("level", F.lit(self.level))
        fields = [c for c in out.columns if c not in s.key]
        return out.withColumn("json", F.to_json(F.struct(*s.key, *fields)))

    def summary(self, s: Series, most: int = 10) -> DataFrame:
        """Text lines for people: the first anomalies of each series and its drift."""
        r = self.report(s)
        first = F.array_join(F.transform(F.slice("anomalies", 1, most), lambda a: F.concat(a["idx"].cast("string"), F.lit(": "), a["raw"], F.lit(" -> "), a["clean"])), "; ")
        line = F.format_string("%d points, %d anomalies. %s. Drift %.3g a step%s", "points", F.size("anomalies"), first, "rate", F.when(F.col("significant"), " (significant)").otherwise(""))
        return r.select(*s.key, line.alias("summary"))


def drift(s: Series) -> DataFrame:
    """(key, rate, significant, exponent): shift between the medians of the first and last thirds of the points that
    aren't missing. Fewer than 9 points have no drift. The exponent is -log10 of the rate, and 4 for no rate at all.
    """
    known = s.having(s.df.where(F.col("x").isNotNull()))
    at = F.row_number().over(known.window())
    n = F.count("*").over(s.whole())
    df = known.df.select(*s.key, "x", at.alias("_i"), n.alias("_n"), F.percentile("x", F.lit(0.5)).over(s.whole()).alias("_med"))
    third = F.floor(F.col("_n") / 3)
    agg = df.groupBy(*s.key).agg(
        F.max("_n").alias("n"),
        F.percentile(F.when(F.col("_i") <= third, F.col("x")), F.lit(0.5)).alias("a"),
        F.percentile(F.when(F.col("_i") > F.col("_n") - third, F.col("x")), F.lit(0.5)).alias("b"),
        F.percentile(F.abs(F.col("x") - F.col("_med")), F.lit(0.5)).alias("mad"),
    )
    t = F.floor(F.col("n") / 3)
    shift = F.col("b") - F.col("a")
    rate = shift / F.greatest(F.lit(1), F.col("n") - t)
    noise = MAD_SCALE * F.when(F.col("mad") == 0, F.lit(1e-12)).otherwise(F.col("mad")) / F.sqrt(t.cast("double"))
    enough = F.col("n") >= 9
    out = agg.select(*s.key, F.when(enough, rate).otherwise(F.lit(0.0)).alias("rate"), F.when(enough, F.abs(shift) > 3 * noise).otherwise(F.lit(False)).alias("significant"), enough.alias("_enough"))
    exponent = F.when(~F.col("_enough"), F.lit(0.0)).when(F.col("rate") == 0, F.lit(4.0)).otherwise(-F.log10(F.abs("rate")))
    keys = s.df.select(*s.key).distinct()  # series without any point that isn't missing have no drift either
    out = keys.join(out.withColumn("exponent", exponent).drop("_enough"), list(s.key), "left")
    return out.select(*s.key, F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("significant", F.lit(False)).alias("significant"), F.coalesce("exponent", F.lit(0.0)).alias("exponent"))


def mad_zscore(s: Series, limit: float = 6.0) -> DataFrame:
    """Adds `z`, the distance from the series' median in scaled median deviations, and `is_anomaly`."""
    whole = s.whole()
    df = s.df.withColumn("_med", F.percentile("x", F.lit(0.5)).over(whole))
    df = df.withColumn("_mad", F.percentile(F.abs(F.col("x") - F.col("_med")), F.lit(0.5)).over(whole))
    z = F.abs(F.col("x") - F.col("_med")) / (MAD_SCALE * F.when(F.col("_mad") == 0, F.lit(1e-12)).otherwise(F.col("_mad")))
    return df.withColumn("z", z).withColumn("is_anomaly", F.coalesce(z > limit, F.lit(False))).drop("_med", "_mad")
