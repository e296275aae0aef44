"""Measures of signals and of repairs, and the sinks that keep them."""

from __future__ import annotations

import hashlib
import json
import math
import platform
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import __version__

SIGNATURE = f"plumbline-{__version__}"


def decibels(v: Column) -> Column:
    return F.when(v > 0, 20 * F.log10(v)).otherwise(F.lit(-99.0))


def levels(df: DataFrame, sample: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., peak_db, rms_db, loudness, crest, and a verdict on each), over samples at full scale 1."""
    out = df.groupBy(*by).agg(F.max(F.abs(F.col(sample))).alias("_p"), F.sqrt(F.avg(F.col(sample) * F.col(sample))).alias("_r"))
    out = out.select(*by, decibels(F.col("_p")).alias("peak_db"), decibels(F.col("_r")).alias("rms_db"))
    out = out.withColumn("loudness", F.col("rms_db") + 3).withColumn("crest", F.col("peak_db") - F.col("rms_db"))
    loud = F.when(F.col("loudness") > -7, "too loud").when(F.col("loudness") < -16, "too quiet").otherwise("fits")
    return out.select(
        "*", F.when(F.col("peak_db") > -1, "may clip").otherwise("fits").alias("peak_verdict"), loud.alias("loudness_verdict"),
        F.when(F.col("crest") < 6, "flat").otherwise("fits").alias("crest_verdict"),
    )


def mono(samples: DataFrame) -> DataFrame:
    """(file, idx, sample): channels averaged."""
    return samples.groupBy("file", "idx").agg(F.avg("sample").alias("sample"))


def fidelity(pairs: DataFrame, original: str, filtered: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., fidelity in percent, removed_variance, peak_db, altered in percent, verdict) of points side by side.

    Points that are missing on a side aren't compared; join two series on their index to cut to the shorter one.
    """
    d, o = F.col(original) - F.col(filtered), F.col(original)
    both = pairs.where(d.isNotNull())
    out = both.groupBy(*by).agg(F.sum(d * d).alias("_dd"), F.sum(o * o).alias("_oo"), F.var_pop(d).alias("removed_variance"), F.max(F.abs(d)).alias("_p"), (100 * F.avg((F.abs(d) > 0.05).cast("double"))).alias("altered"))
    share = F.when(F.col("_oo") > 0, (1 - F.col("_dd") / F.col("_oo")) * 100).otherwise(F.lit(0.0))
    verdict = F.when(share > 99.5, "surgical").when(share >= 95, "balanced").otherwise("aggressive")
    return out.select(*by, share.alias("fidelity"), "removed_variance", decibels(F.coalesce("_p", F.lit(0.0))).alias("peak_db"), "altered", verdict.alias("verdict"))


def variances(pairs: DataFrame, raw: str, filtered: str, by: tuple[str, ...] = ()) -> DataFrame:
    out = pairs.groupBy(*by).agg(F.var_pop(raw).alias("var_raw"), F.var_pop(filtered).alias("var_filtered"))
    return out.withColumn("damping_percent", F.when(F.col("var_raw") > 0, (F.col("var_raw") - F.col("var_filtered")) / F.col("var_raw") * 100).otherwise(F.lit(0.0)))


def trend_report(spark: SparkSession, pairs: DataFrame, raw: str, filtered: str, path: str) -> str:
    """Writes a few lines of text by Spark's writer and returns them."""
    r, n = variances(pairs, raw, filtered).first(), pairs.count()
    lines = [f"Engine: {SIGNATURE}", f"Points: {n}", f"Variance, raw: {r['var_raw'] or 0:.6f}", f"Variance, filtered: {r['var_filtered'] or 0:.6f}", f"Damping: {r['damping_percent']:.2f}%"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return "\n".join(lines)


def _clean(value):
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN"
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, (list, tuple)) else value


def provenance(spark: SparkSession, history: list[dict], path: str) -> str:
    """Writes the records with their surroundings as JSON and returns the SHA-256 of the sorted, indented text without
    the hash, which is then put in. The history is what the driver did, so it is small."""
    payload = {
        "metadata": {"engine": SIGNATURE, "written_utc": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), "environment": {"os": platform.system(), "machine": platform.machine(), "python": platform.python_version(), "spark": spark.version, "tasks": spark.sparkContext.defaultParallelism}},
        "records": _clean(history),
    }
    digest = hashlib.sha256(json.dumps(payload, sort_keys=True, indent=4).encode()).hexdigest()
    payload["metadata"]["integrity_sha256"] = digest
    spark.createDataFrame([(json.dumps(payload, indent=4),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return digest


def verified(spark: SparkSession, path: str) -> bool:
    """Does an archive still have its hash?"""
    payload = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    said = payload["metadata"].pop("integrity_sha256")
    return said == hashlib.sha256(json.dumps(payload, sort_keys=True, indent=4).encode()).hexdigest()
