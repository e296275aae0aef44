"""Shield around a model: inputs are pulled towards a reference, the model runs, outputs are pulled towards theirs.

Instances are series in long form (a scalar series is one instance). Nothing is kept between calls; thresholds are
calibrated on each instance, and results don't depend on how the rows are cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import elementwise as E
from plumbline.functions.windows import Series, with_double
from plumbline.operators.stabilize import Stabilizer, stabilize_batch, stabilize_stream

# Magnitude that values are brought to, reach of the clip in its units, noise of an emergency, and
# the weights of the reference then and otherwise.
TARGET, CLIP, EMERGENCY, HARD_GATE = -4.0, 20.0, 0.05, 0.99
MAD_SCALE = 1.4826


def preclean(s: Series, radius: int = 3, limit: float = 6.0) -> DataFrame:
    """Adds `pre`: missing points as the series' median (0 if it has none), gross outliers as their local median."""
    whole = s.whole()
    df = s.df.withColumn("_v", F.coalesce("x", F.percentile("x", F.lit(0.5)).over(whole), F.lit(0.0)))
    df = df.withColumn("_med", F.percentile("_v", F.lit(0.5)).over(s.frame(radius, radius)))
    df = df.withColumn("_off", F.abs(F.col("_v") - F.col("_med")))
    df = df.withColumn("_mad", F.percentile("_off", F.lit(0.5)).over(whole))
    spread = MAD_SCALE * F.when(F.col("_mad") == 0, F.lit(1e-12)).otherwise(F.col("_mad"))
    return df.withColumn("pre", F.when(F.col("_off") > limit * spread, F.col("_med")).otherwise(F.col("_v"))).drop("_v", "_med", "_off", "_mad")


def blind_reference(s: Series, conf: Stabilizer | None = None) -> DataFrame:
    """Adds `ref`: the precleaned series through the recursive filter."""
    df = preclean(s).withColumn("_raw", F.col("x")).withColumn("x", F.col("pre"))
    out = stabilize_stream(s.having(df), conf)
    return out.withColumn("x", F.col("_raw")).withColumnRenamed("filtered", "ref").drop("_raw", "pre")


def compressed(df: DataFrame, clean: str = "ref", corrupted: str = "x") -> DataFrame:
    """Adds `factor`, shared by both sides and set by the clean value alone, `clean_c`, `corrupted_c` (clipped) and
    `hard` (noise of an emergency, measured before)."""
    c = F.col(clean)
    e = F.greatest(F.log10(F.abs(c) + 1e-15), F.lit(TARGET))
    df = df.withColumn("factor", F.when(c != 0, F.pow(F.lit(10.0), TARGET - e)).otherwise(F.lit(1.0)))
    bound = CLIP * 10.0**TARGET
    return df.select(
        "*", (c * F.col("factor")).alias("clean_c"), E.clip(F.col(corrupted) * F.col("factor"), -bound, bound).alias("corrupted_c"),
        F.coalesce(F.abs(F.col(corrupted) - c) > EMERGENCY, F.lit(False)).alias("hard"),
    )


def input_shield(s: Series, reference: str = "ref", conf: Stabilizer | None = None) -> DataFrame:
    """Adds `protected` and `margin_in`."""
    df = compressed(s.df, reference).withColumn("_raw", F.col("x")).withColumn("x", F.col("corrupted_c"))
    out = stabilize_batch(s.having(df), conf, by=s.key, hard="hard")
    f1 = F.when(F.isnan("filtered"), F.col("clean_c")).otherwise(F.coalesce("filtered", "clean_c"))
    weight = F.when(F.col("hard"), F.lit(HARD_GATE)).otherwise(E.gate(F.col("corrupted_c")))
    out = out.withColumn("x", F.col("_raw")).withColumn("protected", (f1 - weight * (f1 - F.col("clean_c"))) / F.col("factor"))
    return out.withColumn("margin_in", E.margin(F.col("x"), F.col("protected"))).drop("_raw", "filtered", "factor", "clean_c", "corrupted_c", "hard")


def output_shield(df: DataFrame, output: str = "output", reference: str = "output_ref") -> DataFrame:
    """Adds `shielded` and `margin_out`; a value missing on both sides becomes 0."""
    raw = E.finite(F.col(output))
    df = df.withColumn("shielded", F.coalesce(E.damping_blend(raw, E.finite(F.col(reference))), F.lit(0.0)))
    return df.withColumn("margin_out", E.margin(raw, F.col("shielded")))


def by_instance(model: Callable[[np.ndarray], np.ndarray], df: DataFrame, s: Series, source: str, target: str) -> DataFrame:
    """Adds `target`, a model of whole instances: called with the values in order, it returns as many."""

    order = list(s.order)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out = np.asarray(model(rows[source].to_numpy(dtype=float, na_value=np.nan)), float).ravel()
        if len(out) != len(rows):
            raise ValueError(f"the model returned {len(out)} values for {len(rows)}")
        return rows.assign(**{target: out})

    return df.groupBy(*s.key).applyInPandas(run, with_double(df.schema, target))


@dataclass(frozen=True)
class ModelShield:
    """model: an expression of a column (also a pandas UDF), or with `whole` a function of an instance's values."""

    model: Callable | None = None
    whole: bool = False
    conf: Stabilizer = field(default_factory=lambda: Stabilizer(threshold=0.15, alpha=0.05))
    use_input: bool = True
    use_output: bool = True

    def _modelled(self, df: DataFrame, s: Series, source: str, target: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(target, F.col(source))
        return by_instance(self.model, df, s, source, target) if self.whole else df.withColumn(target, self.model(F.col(source)))

    def protect(self, s: Series, reference: str | None = None) -> DataFrame:
        """Adds `ref`, `protected`, `margin_in`, `output`, `shielded` and `margin_out` to each point.

        Without a reference column the reference is made blindly, and outputs are held against their own filtered
        course; with one, against the model of the reference.
        """
        if reference is None:
            df = blind_reference(s, self.conf)
        else:
            df = s.df.withColumn("ref", F.coalesce(E.finite(F.col(reference)), F.lit(0.0)))
        if self.use_input:
            df = input_shield(s.having(df), "ref", self.conf)
        else:
            df = df.withColumn("protected", F.col("x")).withColumn("margin_in", F.lit(0.0))
        df = self._modelled(df, s, "protected", "output")
        if not self.use_output:
            return df.withColumn("shielded", F.col("output")).withColumn("margin_out", F.lit(0.0))
        if reference is not None:
            df = self._modelled(df, s, "ref", "output_ref")
        else:
            df = df.withColumn("_raw", F.col("x")).withColumn("x", E.finite(F.col("output")))
            df = stabilize_batch(s.having(df), self.conf, by=s.key).withColumnRenamed("filtered", "output_ref")
            df = df.withColumn("x", F.col("_raw")).drop("_raw")
        return output_shield(df).drop("output_ref")


def margins(protected: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Mean and greatest margins, overall or per key."""
    return protected.groupBy(*key).agg(*[f(c).alias(f"{n}_{c}") for c in ("margin_in", "margin_out") for n, f in (("mean", F.avg), ("max", F.max))])


