"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows.

The series are `events` by user in order of time; missing values and spikes are put in by rule on event_id, on both
sides alike. Vectors are `embeddings`. Floating-point results are rounded, since engines add in different orders.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import runtime
from plumbline.functions import elementwise as E
from plumbline.functions.windows import Series, in_blocks, own_rows
from plumbline.operators import detect, shield, similarity, stabilize, trigger, vectors
from plumbline.operators.detect import chauvenet_cut
from plumbline.plans import pipeline
from plumbline.sources import readers, reports

KEY = ("user_id", "event_id")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corrupted(spark: SparkSession, d: str) -> Series:
    value = F.when(F.col("event_id") % 37 == 0, F.lit(None)).when(F.col("event_id") % 53 == 0, F.col("value") * 1000).otherwise(F.col("value"))
    return Series.of(table(spark, d, "events").select("user_id", "event_id", "ts", F.col("value").alias("given"), value.alias("value")), "user_id", ("ts", "event_id"))


def r6(c: str | Column, places: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if isinstance(c, str) else c, places)
    return out.alias(name) if name else out


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def exploded(df: DataFrame, v: Column, places: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", places).alias("value"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


X = """x AS (SELECT user_id, event_id, ts, given, v AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM (SELECT user_id, event_id, ts, value AS given, CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 53 = 0 THEN value * 1000 ELSE value END AS v FROM events))"""


def over(before, after) -> str:
    at = lambda n: f"{n} FOLLOWING" if n >= 0 else f"{-n} PRECEDING"
    return f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {at(-before) if before else 'CURRENT ROW'} AND {at(after) if after else 'CURRENT ROW'})"


NEAR, FAR = over(10, 10), over(30, 30)
FINISH = "SELECT user_id, event_id, round(CASE WHEN flag THEN med ELSE x END, 6) AS clean, flag AS is_anomaly FROM f"
STD = lambda a: f"sqrt(list_sum(list_transform({a}, lambda q: (q - list_avg({a})) * (q - list_avg({a})))) / len({a}))"


def flagged(df: DataFrame) -> DataFrame:
    return df.select(*KEY, r6("clean"), "is_anomaly")


# ---- detectors ------------------------------------------------------------------------------------------------


@query(f"WITH {X}, a AS (SELECT *, list(x) FILTER (x IS NOT NULL) {NEAR} AS w FROM x), b AS (SELECT *, list_median(w) AS med FROM a), c AS (SELECT *, 1.4826 * list_median(list_transform(w, lambda q: abs(q - med))) AS mad FROM b), f AS (SELECT *, coalesce(len(w) >= 3 AND x IS NOT NULL AND CASE WHEN mad < 1e-12 THEN abs(x - med) > 1e-9 ELSE abs(x - med) > 3 * mad END, false) AS flag FROM c) {FINISH}")
def clean_hampel(spark, d):
    return flagged(detect.hampel(corrupted(spark, d)))


@query(f"WITH {X}, a AS (SELECT *, quantile_cont(x, 0.25) {NEAR} AS q1, quantile_cont(x, 0.5) {NEAR} AS med, quantile_cont(x, 0.75) {NEAR} AS q3, count(x) {NEAR} AS n FROM x), f AS (SELECT *, coalesce(n >= 4 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)), false) AS flag FROM a) {FINISH}")
def clean_tukey(spark, d):
    return flagged(detect.tukey(corrupted(spark, d)))


CUTS = ", ".join(f"({n}, {chauvenet_cut(n)!r}::DOUBLE)" for n in range(3, 22))


@query(f"WITH {X}, cuts(n, cut) AS (VALUES {CUTS}), a AS (SELECT *, avg(x) {NEAR} AS m, stddev_pop(x) {NEAR} AS s, count(x) {NEAR} AS cnt, quantile_cont(x, 0.5) {NEAR} AS med FROM x), f AS (SELECT a.*, coalesce(cut IS NOT NULL AND s >= 1e-12 AND abs(x - m) > cut * s, false) AS flag FROM a LEFT JOIN cuts ON cnt = n) {FINISH}")
def clean_chauvenet(spark, d):
    return flagged(detect.chauvenet(corrupted(spark, d)))


def clip_rounds(nb: str, source: str) -> str:
    """Five rounds as chained tables k0 to k5 over `source`."""
    out = [f"k0 AS (SELECT *, {nb} AS kept FROM {source})"]
    for i in range(5):
        out.append(f"m{i} AS (SELECT *, list_avg(kept) AS mm, {STD('kept')} AS ss FROM k{i})")
        out.append(f"k{i + 1} AS (SELECT * EXCLUDE (kept, mm, ss), CASE WHEN len(kept) < 2 OR ss < 1e-12 THEN kept ELSE list_filter({nb}, lambda q: abs(q - mm) <= 3 * ss) END AS kept FROM m{i})")
    return ", ".join(out)


NB = f"list_concat(coalesce(list(x) FILTER (x IS NOT NULL) {over(10, -1)}, []), coalesce(list(x) FILTER (x IS NOT NULL) {over(-1, 10)}, []))"


@query(f"WITH {X}, a AS (SELECT *, {NB} AS nb FROM x), {clip_rounds('nb', 'a')}, z AS (SELECT *, list_avg(kept) AS m, {STD('kept')} AS s, list_median(kept) AS med FROM k5), f AS (SELECT *, coalesce(len(nb) >= 3 AND CASE WHEN s < 1e-12 THEN abs(x - m) > 1e-9 ELSE abs(x - m) > 3 * s END, false) AS flag FROM z) {FINISH}")
def clean_sigma_clip(spark, d):
    return flagged(detect.sigma_clip(corrupted(spark, d)))


def histogram_sql(a: str) -> str:
    return f"list_transform(range(0, bins), lambda k: 1.0 + len(list_filter({a}, lambda q: q >= low + k * ((high - low) / bins) AND (q < low + (k + 1) * ((high - low) / bins) OR k = bins - 1))))"


JSD = f"""j0 AS (SELECT *, least(list_min(w), list_min(wide)) AS low, greatest(list_max(w), list_max(wide)) AS high, greatest(3, least(10, (len(w) + len(wide)) // 6)) AS bins FROM a),
j1 AS (SELECT *, {histogram_sql('w')} AS pc, {histogram_sql('wide')} AS qc FROM j0),
j2 AS (SELECT *, list_transform(list_zip(pc, qc), lambda z: [z[1] / list_sum(pc), z[2] / list_sum(qc)]) AS pq FROM j1),
j AS (SELECT * EXCLUDE (pc, qc, pq), CASE WHEN len(w) < 4 OR w IS NULL THEN 0.0 WHEN high - low < 1e-12 THEN 0.0 ELSE list_sum(list_transform(pq, lambda z: 0.5 * z[1] * log2(z[1] / (0.5 * (z[1] + z[2]))) + 0.5 * z[2] * log2(z[2] / (0.5 * (z[1] + z[2]))))) END AS jsd FROM j2)"""
WIDE = f"list(x) FILTER (x IS NOT NULL) {NEAR} AS w, list(x) FILTER (x IS NOT NULL) {FAR} AS wide"


@query(f"WITH {X}, a AS (SELECT *, {WIDE} FROM x), {JSD} SELECT user_id, event_id, round(jsd, 6) AS jsd FROM j")
def jsd_local_wide(spark, d):
    return detect.divergence(corrupted(spark, d)).select(*KEY, r6("jsd"))


@query(f"""WITH {X}, a AS (SELECT *, {WIDE}, {NB} AS nb FROM x), {JSD}, {clip_rounds('nb', 'j')},
p0 AS (SELECT *, list_median(w) AS med, list_avg(w) AS mw, {STD('w')} AS sw, (quantile_w[2] - quantile_w[1]) / 1.349 AS iq, CASE WHEN len(nb) >= 3 THEN list_avg(kept) END AS mk, CASE WHEN len(nb) >= 3 THEN {STD('kept')} END AS sk FROM (SELECT *, list_aggregate(w, 'quantile_cont', [0.25, 0.75]) AS quantile_w FROM k5)),
p1 AS (SELECT *, 1.4826 * list_median(list_transform(w, lambda q: abs(q - med))) AS sm FROM p0),
p2 AS (SELECT *, CASE WHEN len(w) >= 4 AND x IS NOT NULL THEN list_filter([[mw, sw], [med, iq], [med, sm], [mk, sk]], lambda c: c[2] > 1e-12) END AS pairs FROM p1),
p3 AS (SELECT *, list_sum(list_transform(pairs, lambda c: 1 / (c[2] * c[2]))) AS inv, list_sum(list_transform(pairs, lambda c: c[1] / (c[2] * c[2]))) AS top FROM p2),
p4 AS (SELECT *, CASE WHEN len(pairs) > 0 THEN abs(x - top / inv) * sqrt(inv) ELSE 0.0 END AS pressure, CASE WHEN len(pairs) > 0 THEN 8.0 * (1 + 3.0 * jsd) ELSE 8.0 END AS eff_threshold FROM p3),
f AS (SELECT *, pressure > eff_threshold AS flag FROM p4)
SELECT user_id, event_id, round(pressure, 4) AS pressure, round(eff_threshold, 4) AS eff_threshold, flag AS is_anomaly, round(CASE WHEN flag THEN med ELSE x END, 6) AS clean FROM f""")
def pressure_combined(spark, d):
    return detect.pressure(corrupted(spark, d)).select(*KEY, r6("pressure", 4), r6("eff_threshold", 4), "is_anomaly", r6("clean"))


@query(f"WITH {X}, a AS (SELECT *, quantile_cont(x, 0.5) {over(6, 6)} AS med, list(x) FILTER (x IS NOT NULL) {over(2, 2)} AS w FROM x), b AS (SELECT *, x - med AS off FROM a), c AS (SELECT *, len(list_filter(w, lambda q: sign(q - med) = sign(off) AND abs(q - med) > 0.7 * abs(off))) AS along FROM b) SELECT user_id, event_id, round(CASE WHEN x IS NULL OR abs(off) < 1e-9 OR along * 2 > len(w) THEN x ELSE med END, 6) AS clean FROM c")
def heal_sustained(spark, d):
    return detect.heal(corrupted(spark, d)).select(*KEY, r6("clean"))


@query(f"WITH {X} SELECT user_id, event_id, round(quantile_cont(x, 0.5) {over(2, 2)}, 6) AS med FROM x")
def rolling_median(spark, d):
    return detect.rolling_median(corrupted(spark, d)).select(*KEY, r6("med"))


@query(SQL["clean_tukey"])
def clean_tukey_in_blocks(spark, d):
    """The same rows as on whole series, from blocks that windows process apart."""
    s = in_blocks(corrupted(spark, d).indexed(), "idx", 10, 25)
    return flagged(own_rows(detect.tukey(s)))


# ---- the one-dimensional shield -------------------------------------------------------------------------------

# Missing points are isolated here but for some users; those take the recursion below.
FILL = f"""n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, median(x) OVER (PARTITION BY user_id) AS whole FROM x),
r AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE least(20, greatest(3, n // 3)) END AS rad FROM n),
fl AS (WITH RECURSIVE go AS (
  SELECT user_id, 0::BIGINT AS idx, CASE WHEN any_value(rad) >= 0 THEN []::DOUBLE[] END AS done FROM r GROUP BY user_id
  UNION ALL
  SELECT g.user_id, g.idx + 1, list_append(g.done, coalesce(c.x, (SELECT median(u.v) FROM (
      SELECT unnest(list_slice(g.done, greatest(1, g.idx + 1 - greatest(c.rad, 3)), g.idx)) AS v
      UNION ALL SELECT y.x FROM r y WHERE y.user_id = c.user_id AND y.idx > c.idx AND y.idx <= c.idx + greatest(c.rad, 3) AND y.x IS NOT NULL) u), c.whole, 0.0))
  FROM go g JOIN r c ON c.user_id = g.user_id AND c.idx = g.idx)
SELECT r.*, last.done[r.idx + 1] AS filled FROM r JOIN (SELECT user_id, arg_max(done, idx) AS done FROM go GROUP BY user_id) last USING (user_id))"""
# The window of a point, its centre and the scale of its steps, then the score and what follows from it.
TRIG = f"""t0 AS (SELECT *, list(filled) {over(20, -1)} AS w20, lag(filled, 1) OVER o AS p1, lag(filled, 2) OVER o AS p2 FROM fl WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
t1 AS (SELECT *, CASE WHEN len(w20) > rad THEN list_slice(w20, len(w20) - rad + 1, len(w20)) ELSE w20 END AS w FROM t0),
t2 AS (SELECT *, list_transform(range(1, len(w)), lambda i: w[i + 1] - w[i]) AS steps, {{base}} AS b FROM t1),
t3 AS (SELECT *, CASE WHEN len(w) >= 3 THEN greatest({STD('steps')}, 1e-6) ELSE 1e-6 END AS s, p1 - p2 AS g, filled - b AS off FROM t2),
t4 AS (SELECT *, least(greatest(0.6 * (CASE WHEN abs(off) > 1e-12 AND abs(g) > 1e-12 THEN sign(off) * sign(g) ELSE 0 END + 1) / 2 + 0.4 * (1 - abs(off) / s), 0), 1) AS phi FROM t3),
t5 AS (SELECT *, CASE WHEN abs(b) > 1e-12 AND abs(filled) > 1e-12 THEN 5 * least(greatest(ln(abs(filled) / abs(b)), -5), 5) * phi ELSE 0.0 END AS v FROM t4),
t AS (SELECT *, CASE WHEN idx < 2 OR w IS NULL THEN 1 WHEN abs(v) > 1e-2 THEN 1 ELSE 0 END AS trigger, {{put}} AS put FROM t5),
sh AS (SELECT *, CASE WHEN trigger = 1 THEN filled ELSE put END AS shielded FROM t)"""
BLIND = TRIG.format(base="list_avg(w)", put="list_median(w)")
GIVEN = TRIG.format(base="given", put="given")


@query(f"WITH {X}, {FILL} SELECT user_id, event_id, round(filled, 6) AS filled FROM fl")
def fill_gaps(spark, d):
    return trigger.fill(corrupted(spark, d)).select(*KEY, r6("filled"))


@query(f"WITH {X}, {FILL}, {BLIND} SELECT user_id, event_id, trigger, round(shielded, 6) AS clean FROM sh")
def trigger_blind(spark, d):
    return trigger.shield(corrupted(spark, d)).select(*KEY, "trigger", r6(F.col("shielded")).alias("clean"))


@query(f"WITH {X}, {FILL}, {GIVEN} SELECT user_id, event_id, trigger, round(shielded, 6) AS clean FROM sh")
def trigger_reference(spark, d):
    return trigger.shield(corrupted(spark, d), reference="given").select(*KEY, "trigger", r6(F.col("shielded")).alias("clean"))


UNION = """u0 AS (SELECT *, abs(filled - shielded) AS dev, count(x) OVER u AS nx FROM sh WINDOW u AS (PARTITION BY user_id)),
u1 AS (SELECT *, avg(dev) OVER u AS dm, stddev_pop(dev) OVER u AS ds FROM u0 WINDOW u AS (PARTITION BY user_id)),
u2 AS (SELECT *, median(abs(x - whole)) OVER (PARTITION BY user_id) AS mad FROM u1),
an AS (SELECT *, 1 - trigger AS k, dev > greatest(dm + 2 * ds, 1e-12) OR (nx >= 4 AND coalesce(abs(coalesce(x, whole) - whole) / (1.4826 * CASE WHEN mad = 0 THEN 1e-12 ELSE mad END) > 6, false)) OR x IS NULL AS is_anomaly FROM u2)"""


@query(f"WITH {X}, {FILL}, {BLIND}, {UNION} SELECT user_id, event_id, k, is_anomaly FROM an")
def trigger_report(spark, d):
    return trigger.Shield().analyze(corrupted(spark, d)).select(*KEY, "k", "is_anomaly")


@query(f"WITH {X}, {FILL}, {BLIND} SELECT user_id, event_id, level, round(filled - (1 - trigger) * (1 - level) * (filled - shielded), 6) AS clean FROM sh, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) l(level)")
def level_blend(spark, d):
    s = corrupted(spark, d)
    parts = [trigger.Shield(level=level).analyze(s).select(*KEY, F.lit(level).alias("level"), r6("clean")) for level in (0.0, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {X}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, median(x) OVER (PARTITION BY user_id) AS med FROM x WHERE x IS NOT NULL),
g AS (SELECT user_id, max(n) AS n, max(n) // 3 AS t, median(x) FILTER (i <= n // 3) AS a, median(x) FILTER (i > n - n // 3) AS b, median(abs(x - med)) AS mad FROM k GROUP BY user_id),
h AS (SELECT *, (b - a) / greatest(1, n - t) AS rate FROM g)
SELECT user_id, round(CASE WHEN n >= 9 THEN rate ELSE 0 END, 6) AS rate, n >= 9 AND abs(b - a) > 3 * 1.4826 * CASE WHEN mad = 0 THEN 1e-12 ELSE mad END / sqrt(t) AS significant, round(CASE WHEN n < 9 THEN 0.0 WHEN rate = 0 THEN 4.0 ELSE -log10(abs(rate)) END, 6) AS exponent FROM h""")
def drift(spark, d):
    return trigger.drift(corrupted(spark, d)).select("user_id", r6("rate"), "significant", r6("exponent"))


@query(f"WITH {X}, a AS (SELECT *, median(x) OVER (PARTITION BY user_id) AS med FROM x), b AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY user_id) AS mad FROM a) SELECT user_id, event_id, round(abs(x - med) / (1.4826 * mad), 4) AS z, coalesce(abs(x - med) / (1.4826 * mad) > 6, false) AS is_anomaly FROM b")
def mad_zscore(spark, d):
    return trigger.mad_zscore(corrupted(spark, d)).select(*KEY, r6("z", 4), "is_anomaly")


DRIFT = """dk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS cnt, median(x) OVER (PARTITION BY user_id) AS mid FROM x WHERE x IS NOT NULL),
dg AS (SELECT user_id, max(cnt) AS cnt, max(cnt) // 3 AS t, median(x) FILTER (i <= cnt // 3) AS a, median(x) FILTER (i > cnt - cnt // 3) AS b FROM dk GROUP BY user_id),
dr AS (SELECT user_id, CASE WHEN cnt >= 9 THEN (b - a) / greatest(1, cnt - t) ELSE 0.0 END AS rate FROM dg)"""


@query(f"WITH {X}, {FILL}, {BLIND}, {UNION}, {DRIFT} SELECT user_id, count(*) AS points, round(avg(k), 6) AS mean_k, 1.0::DOUBLE AS level, count(*) FILTER (is_anomaly) AS n_anomalies, coalesce(min(idx) FILTER (is_anomaly), -1) AS first_at, coalesce(sum(idx) FILTER (is_anomaly), 0)::BIGINT AS sum_at, count(*) FILTER (is_anomaly AND x IS NULL) AS n_missing, round(any_value(rate), 6) AS rate FROM an JOIN dr USING (user_id) GROUP BY user_id")
def report_json(spark, d):
    """Fields of the JSON text of each report."""
    form = "points long, mean_k double, level double, rate double, anomalies array<struct<idx: long, raw: string, clean: string, k: int>>"
    r = trigger.Shield().report(corrupted(spark, d)).select("user_id", F.from_json("json", form).alias("j")).select("user_id", "j.*")
    at = F.transform("anomalies", lambda a: a["idx"])
    return r.select(
        "user_id", "points", r6("mean_k"), "level", F.size("anomalies").cast("long").alias("n_anomalies"), F.coalesce(F.array_min(at), F.lit(-1).cast("long")).alias("first_at"),
        F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a + i).alias("sum_at"), F.size(F.filter("anomalies", lambda a: a["raw"] == "NaN")).cast("long").alias("n_missing"), r6("rate"),
    )


@query("SELECT o_orderkey, round(least(greatest(1 - h / (ln(greatest(2, v)) + 1e-12), 0), 1), 6) AS level FROM (SELECT o_orderkey, (o_orderkey % 100) / 10.0 AS h, o_custkey % 50 AS v FROM orders)")
def entropy_level(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(E.level_from_entropy(F.col("o_orderkey") % 100 / 10.0, F.col("o_custkey") % 50), 6).alias("level"))


# ---- single values --------------------------------------------------------------------------------------------


@query("SELECT event_id, round(CASE WHEN value > 0 THEN pow(10, -4 - log10(value)) ELSE 1 END, 9) AS factor, round(CASE WHEN value > 0 THEN value * pow(10, -4 - log10(value)) ELSE 0 END, 9) AS encoded, round(value, 6) AS decoded FROM events")
def log_scale(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").withColumn("f", E.log_factor(v)).withColumn("e", E.log_encode(v))
    return e.select("event_id", F.round("f", 9).alias("factor"), F.round("e", 9).alias("encoded"), F.round(E.log_decode(F.col("e"), F.col("f")), 6).alias("decoded"))


GAIN = f"(1 / (1 + exp(-(least(greatest({{d}}, 0), 5) - 2))))"
BLEND = f"""a AS (SELECT *, coalesce(raw, ref) AS p, coalesce(ref, raw) AS q FROM src), b AS (SELECT *, abs(p - q) AS d FROM a),
c AS (SELECT *, least(greatest(1 - d / (2 * greatest(abs(p), 1e-3)), 0), 1) AS near FROM b),
e AS (SELECT *, CASE WHEN raw IS NULL OR ref IS NULL THEN {E.GAIN_HIGH!r} ELSE least(greatest((1 - near) * {GAIN.format(d='d')} * {E.K_MAX!r} + near * least(greatest(0.25 + d / ({E.C_ANOMALY!r} + d + 1e-7) * ({E.K_MAX!r} - 0.25), 0.25), {E.K_MAX!r}), {E.GAIN_LOW!r}), {E.GAIN_HIGH!r}) END AS k FROM c)"""


@query(f"WITH {X}, src AS (SELECT user_id, event_id, x AS raw, CASE WHEN event_id % 41 = 0 THEN NULL ELSE given END AS ref FROM x), {BLEND} SELECT user_id, event_id, round((1 - k) * p + k * q, 6) AS blended FROM e")
def blend(spark, d):
    ref = F.when(F.col("event_id") % 41 != 0, F.col("given"))
    return corrupted(spark, d).df.select(*KEY, F.round(E.damping_blend(F.col("x"), ref), 6).alias("blended"))


@query(f"SELECT event_id, round({GAIN.format(d='value')} * ({E.K_MAX!r} - 0.25) + 0.25, 6) AS gain FROM events")
def damping_gain(spark, d):
    return table(spark, d, "events").select("event_id", F.round(E.dynamic_gain(F.col("value")), 6).alias("gain"))


@query("WITH p AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: 4 * (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(sqrt(s + 1e-6) / sqrt(1 + s + 1e-6), 6) AS kappa FROM p")
def curvature(spark, d):
    a, b = embedded(spark, d), embedded(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.curvature(F.col("v"), F.col("u")), 6).alias("kappa"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey / 2 ELSE 3.0 * o_orderkey + 1 END::DOUBLE AS next, CASE WHEN o_orderkey >= 2 AND len(list_filter(range(2, 128), lambda q: q < o_orderkey AND o_orderkey % q = 0)) = 0 THEN 1 ELSE 0 END AS prime FROM orders")
def collatz_step(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", E.collatz_step(n).alias("next"), E.is_prime_small(n).alias("prime"))


WAVE = "({x} / 2) * pow(cos(pi() * {x} / 2), 2) + (3 * {x} + 1) * pow(sin(pi() * {x} / 2), 2)"


@query(f"SELECT event_id, round({WAVE.format(x='value')}, 6) AS smooth FROM events")
def collatz_smooth(spark, d):
    return table(spark, d, "events").select("event_id", F.round(E.collatz_smooth(F.col("value")), 6).alias("smooth"))


PRIMES = f"[{', '.join(map(str, E.primes_below(256)))}]::DOUBLE[]"


def radical_sql(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 WHEN {n} = 1 THEN 1.0 ELSE list_reduce(list_concat([1.0::DOUBLE], list_filter({PRIMES}, lambda q: q <= {n} AND {n} % q = 0)), lambda a, b: a * b) END::DOUBLE"


@query(f"SELECT o_orderkey, {radical_sql('n')} AS rad FROM (SELECT o_orderkey, o_orderkey::DOUBLE AS n FROM orders)")
def radical(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.radical(F.col("o_orderkey").cast("double")).alias("rad"))


@query(f"SELECT o_orderkey, round(abs({radical_sql('n')} - abs(c)), 6) AS gap FROM (SELECT o_orderkey, o_orderkey::DOUBLE AS n, o_totalprice AS c FROM orders)")
def abc_gap(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(E.abc_gap(F.col("o_orderkey").cast("double"), F.col("o_totalprice")), 6).alias("gap"))


@query("SELECT event_id, 0.85::DOUBLE AS gate FROM events")
def gate_constant(spark, d):
    return table(spark, d, "events").select("event_id", E.gate(F.col("value")).alias("gate"))


@query(f"WITH {X}, a AS (SELECT event_id, x, coalesce(x, given) AS val, given FROM x), b AS (SELECT *, abs(val - given) * 100 + 3 AS n FROM a), c AS (SELECT *, abs({WAVE.format(x='n')}) AS wave FROM b) SELECT event_id, round(CASE WHEN x IS NULL THEN 0.85 ELSE 0.10 + 0.75 / (1 + exp(-abs({radical_sql('wave')} - abs(val)))) END, 6) AS gate FROM c")
def gate_smooth(spark, d):
    return corrupted(spark, d).df.select("event_id", F.round(E.gate_smooth(F.col("x"), F.col("given")), 6).alias("gate"))


# ---- measures -------------------------------------------------------------------------------------------------

DB = "CASE WHEN {v} > 0 THEN 20 * log10({v}) ELSE -99.0 END"


@query(f"WITH {X}, f AS (SELECT user_id, x / 500 AS a, given / 500 AS b FROM x WHERE x IS NOT NULL), g AS (SELECT user_id, sum((a - b) * (a - b)) AS dd, sum(a * a) AS oo, var_pop(a - b) AS rv, max(abs(a - b)) AS p, 100 * avg(CASE WHEN abs(a - b) > 0.05 THEN 1.0 ELSE 0.0 END) AS alt FROM f GROUP BY user_id), h AS (SELECT *, CASE WHEN oo > 0 THEN (1 - dd / oo) * 100 ELSE 0 END AS fid FROM g) SELECT user_id, round(fid, 4) AS fidelity, round(rv, 4) AS removed_variance, round({DB.format(v='p')}, 4) AS peak_db, round(alt, 4) AS altered, CASE WHEN fid > 99.5 THEN 'surgical' WHEN fid >= 95 THEN 'balanced' ELSE 'aggressive' END AS verdict FROM h")
def fidelity(spark, d):
    pairs = corrupted(spark, d).df.withColumn("a", F.col("x") / 500).withColumn("b", F.col("given") / 500)
    return reports.fidelity(pairs, "a", "b", ("user_id",)).select("user_id", r6("fidelity", 4), r6("removed_variance", 4), r6("peak_db", 4), r6("altered", 4), "verdict")


@query(f"WITH g AS (SELECT user_id, max(abs(value / 500)) AS p, sqrt(avg(value / 500 * (value / 500))) AS r FROM events GROUP BY user_id), h AS (SELECT user_id, {DB.format(v='p')} AS p, {DB.format(v='r')} AS r FROM g) SELECT user_id, round(p, 4) AS peak_db, round(r, 4) AS rms_db, round(r + 3, 4) AS loudness, round(p - r, 4) AS crest, CASE WHEN p > -1 THEN 'may clip' ELSE 'fits' END AS peak_verdict, CASE WHEN r + 3 > -7 THEN 'too loud' WHEN r + 3 < -16 THEN 'too quiet' ELSE 'fits' END AS loudness_verdict, CASE WHEN p - r < 6 THEN 'flat' ELSE 'fits' END AS crest_verdict FROM h")
def level_stats(spark, d):
    e = table(spark, d, "events").withColumn("sample", F.col("value") / 500)
    out = reports.levels(e, by=("user_id",))
    return out.select("user_id", *(r6(c, 4) for c in ("peak_db", "rms_db", "loudness", "crest")), "peak_verdict", "loudness_verdict", "crest_verdict")


@query(f"WITH {X}, g AS (SELECT user_id, var_pop(x) AS a, var_pop(given) AS b FROM x GROUP BY user_id) SELECT user_id, round(a, 2) AS var_raw, round(b, 2) AS var_filtered, round(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END, 4) AS damping_percent FROM g")
def variance_report(spark, d):
    return reports.variances(corrupted(spark, d).df, "x", "given", ("user_id",)).select("user_id", r6("var_raw", 2), r6("var_filtered", 2), r6("damping_percent", 4))


# ---- similarity -----------------------------------------------------------------------------------------------


def score_sql(v: str, q: str) -> str:
    """Resonance of a vector with a query of norm 1."""
    w = min(0.85, max(0.10, 0.60 + 0.25 * similarity.KAPPA))
    d, p = "abs(z[1] - z[2])", "z[1]"
    near = f"least(greatest(1 - {d} / (2 * greatest(abs({p}), 1e-3)), 0), 1)"
    k = f"least(greatest((1 - {near}) * {GAIN.format(d=d)} * {E.K_MAX!r} + {near} * least(greatest(0.25 + {d} / ({E.C_ANOMALY!r} + {d} + 1e-7) * ({E.K_MAX!r} - 0.25), 0.25), {E.K_MAX!r}), {E.GAIN_LOW!r}), {E.GAIN_HIGH!r})"
    mixed = f"list_transform(list_zip({v}, {q}), lambda z: (1 - {k}) * z[1] + {k} * z[2])"
    cosine = lambda a: f"list_dot_product({a}, {q}) / greatest(sqrt(list_dot_product({a}, {a})), 1e-8)"
    return f"((1 - {w!r}) * ({cosine(v)}) + {w!r} * ({cosine(mixed)})) * {similarity.stress_factor()!r}"


VEC = "e AS (SELECT vec_id, list_transform(embedding, lambda q: q::DOUBLE) AS v FROM embeddings)"
ONE = "qq AS (SELECT list_transform(v, lambda z: z / sqrt(list_dot_product(v, v))) AS q FROM e WHERE vec_id = 7)"


@query(f"WITH {VEC}, {ONE} SELECT vec_id, round({score_sql('v', 'q')}, 6) AS score FROM e, qq")
def similarity_scores(spark, d):
    e = embedded(spark, d)
    return similarity.scores(e, e.where("vec_id = 7").select(F.col("v").alias("query")), "v").select("vec_id", r6("score"))


@query(f"WITH {VEC}, {ONE} SELECT vec_id, round({score_sql('v', 'q')}, 6) AS score FROM e, qq ORDER BY {score_sql('v', 'q')} DESC, vec_id LIMIT 1")
def similarity_top1(spark, d):
    e = embedded(spark, d)
    return similarity.top(e, e.where("vec_id = 7").select(F.col("v").alias("query")), 1, "v").select("vec_id", r6("score"))


@query(f"""WITH {VEC}, bank AS (SELECT vec_id % 3 AS shape, vec_id AS seq, v FROM e QUALIFY row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id DESC) <= 32),
asked AS (SELECT vec_id AS id, vec_id % 3 AS shape, list_transform(v, lambda z: z / sqrt(list_dot_product(v, v))) AS q FROM e),
met AS (SELECT id, seq, {score_sql('b.v', 'a.q')} AS score FROM asked a JOIN bank b USING (shape)),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) = 1)
SELECT id, CASE WHEN score >= 0.9 THEN seq END AS recalled, round(score, 6) AS score FROM best""")
def bank_recall_whole(spark, d):
    """Every vector asked and every one remembered."""
    e = embedded(spark, d).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("shape"), F.col("v").alias("vec"))
    return similarity.recall(e, e.withColumnRenamed("id", "seq")).select("id", "recalled", r6("score"))


# ---- op lists and vectors -------------------------------------------------------------------------------------

UNIT = "CASE WHEN sqrt(list_dot_product({v}, {v})) > 0 THEN list_transform({v}, lambda z: z / sqrt(list_dot_product({v}, {v}))) ELSE {v} END"
OPS = {
    "relu": (["relu"], "list_transform(v, lambda z: greatest(z, 0))"),
    "sigmoid": (["sigmoid"], "list_transform(v, lambda z: 1 / (1 + exp(-z)))"),
    "tanh": (["tanh"], "list_transform(v, lambda z: tanh(z))"),
    "scale": (["scale"], f"list_transform(v, lambda z: z * {E.PHI!r} + 0.25)"),
    "clip": ([("clip", -0.1, 0.1)], "list_transform(v, lambda z: least(greatest(z, -0.1), 0.1))"),
    "l2": (["l2_normalize"], UNIT.format(v="v")),
    "identity": (["identity", "no such op"], "v"),
    "chain": (["relu", ("scale", 2, -0.1), "l2_normalize"], UNIT.format(v="list_transform(v, lambda z: greatest(z, 0) * 2 - 0.1)")),
}
PLACES = "SELECT vec_id, unnest(range(0, len(w))) AS pos, round(unnest(w), 6) AS value FROM s"


def _op_query(name: str, ops: list, sql: str, blocks: bool = False):
    def run(spark, d):
        e = embedded(spark, d)
        return exploded(e, (pipeline.run_in_blocks if blocks else pipeline.run)(pipeline.compiled(ops), F.col("v")))

    run.__name__ = name
    query(f"WITH {VEC}, s AS (SELECT vec_id, {sql} AS w FROM e) {PLACES}")(run)


for _name, (_ops, _sql) in OPS.items():
    _op_query(f"pipe_{_name}", _ops, _sql)
_op_query("pipe_in_blocks", *OPS["chain"], blocks=True)


@query(f"WITH {VEC}, s AS (SELECT vec_id, list_transform(list_transform(v, lambda z: tanh(z * 2 + 0.1)), lambda t: 2 * t / {pipeline.LOSS_SCALE!r} * (1 - t * t) * 2) AS w FROM e) {PLACES}")
def pipe_grad(spark, d):
    return exploded(embedded(spark, d), pipeline.gradient(pipeline.compiled([("scale", 2, 0.1), "tanh"]), F.col("v")))


GRADS = {
    "relu": (["relu"], "list_transform(v, lambda z: CASE WHEN z > 0 THEN 2 * z / {c} ELSE 0 END)"),
    "sigmoid": (["sigmoid"], "list_transform(list_transform(v, lambda z: 1 / (1 + exp(-z))), lambda t: 2 * t / {c} * t * (1 - t))"),
    "clip": ([("clip", -0.1, 0.1)], "list_transform(v, lambda z: CASE WHEN z BETWEEN -0.1 AND 0.1 THEN 2 * z / {c} ELSE 0 END)"),
    "l2": (["l2_normalize", ("scale", 2, 0.1)], "list_transform(list_zip(u, list_transform(u, lambda z: 4 * (2 * z + 0.1) / {c})), lambda z: (z[2] - z[1] * list_dot_product(u, list_transform(u, lambda t: 4 * (2 * t + 0.1) / {c}))) / n)"),
}


def _grad_query(name: str, ops: list, sql: str) -> None:
    def run(spark, d):
        return exploded(embedded(spark, d), pipeline.gradient(pipeline.compiled(ops), F.col("v")))

    run.__name__ = name
    source = "a AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e), b AS (SELECT *, list_transform(v, lambda z: z / n) AS u FROM a)"
    query(f"WITH {VEC}, {source}, s AS (SELECT vec_id, {sql.format(c=repr(pipeline.LOSS_SCALE))} AS w FROM b) {PLACES}")(run)


for _name, (_ops, _sql) in GRADS.items():
    _grad_query(f"pipe_grad_{_name}", _ops, _sql)


@query(f"WITH {VEC}, s AS (SELECT vec_id, list_transform(range(0, 64), lambda i: v[CASE WHEN i & 16 <> 0 THEN xor(i, 4) ELSE i END + 1]) AS w FROM e) {PLACES}")
def bit_swap(spark, d):
    return exploded(embedded(spark, d), vectors.bit_swap(F.col("v"), 6, target=3, control=1))


@query("WITH b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 48 AS block FROM embeddings) SELECT block, count(*) AS size FROM b GROUP BY block")
def chunk_blocks(spark, d):
    return vectors.row_blocks(table(spark, d, "embeddings").select("vec_id"), "vec_id", 48).groupBy("block").agg(F.count("*").alias("size"))


@query("""WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE l_linenumber END::DOUBLE AS op FROM lineitem),
s AS (SELECT *, sum(CASE WHEN op = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY place) AS i FROM t)
SELECT k, place, op, CASE WHEN op = -1 THEN k * 100::DOUBLE + least(i, 9) ELSE op END AS patched FROM s""")
def patch_params_whole(spark, d):
    """Every line of every order."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), nth.cast("long").alias("place"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(-1.0)).otherwise(F.col("l_linenumber").cast("double")).alias("op"))
    p = t.select("k").distinct().select("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("place")).withColumn("value", F.col("k") * 100.0 + F.col("place"))
    return vectors.patched(t, p, "k", "place")


@query("SELECT * FROM (VALUES ('invert', 0::BIGINT, 0.0::DOUBLE), ('invert', 1, 1), ('invert', 2, 1), ('invert', 3, 0), ('identity', 0, 1), ('identity', 1, 0), ('identity', 2, 0), ('identity', 3, 1), ('edge_detector', 0, -1), ('edge_detector', 1, 2), ('edge_detector', 2, -1), ('blend', 0, 0.5), ('blend', 1, 0.5), ('blend', 2, 0.5), ('blend', 3, 0.5), ('scale_project', 0, round(cos(0.5), 6)), ('scale_project', 1, round(-sin(0.5), 6)), ('scale_project', 2, round(sin(0.5), 6)), ('scale_project', 3, round(cos(0.5), 6)), ('amplify', 0, 0.5), ('amplify', 1, 0), ('amplify', 2, 0), ('amplify', 3, 0.5), ('bias_shift', 0, 0.5), ('bias_shift', 1, -0.5)) t(name, pos, value)")
def transforms(spark, d):
    made = {n: vectors.static_transform(n) for n in vectors.STATIC} | {n: vectors.parametric_transform(n, 0.5) for n in ("scale_project", "amplify", "bias_shift")}
    rows = [(n, i, float(x)) for n, m in made.items() for i, x in enumerate(x for row in m for x in row)]
    return spark.createDataFrame(rows, "name string, pos long, value double").select("name", "pos", r6("value"))


@query(f"WITH {VEC}, s AS (SELECT vec_id, {UNIT.format(v='list_transform(v, lambda z: -z)')} AS w FROM e) {PLACES}")
def noise_bitflip(spark, d):
    return exploded(embedded(spark, d), vectors.inject_noise(F.col("v"), "bitflip", 1.0))


def drawn_sql(i: str, *salt: int) -> str:
    """The number that elementwise.uniform gives for a vector's id, a place, the seed 42 and a salt."""
    return f"((('0x' || substr(md5(concat_ws(':', vec_id, {i}, 42{''.join(f', {k}' for k in salt)})), 1, 13))::UBIGINT + 0.5) / {2.0**52!r}::DOUBLE)"


NORMED = "list_transform(w, lambda z: CASE WHEN list_dot_product(w, w) > 0 THEN z / (sqrt(list_dot_product(w, w)) + 1e-15) ELSE z END)"


@query(f"WITH {VEC}, t AS (SELECT vec_id, list_transform(range(0, 64), lambda i: v[i + 1] + 0.2 * sqrt(-2 * ln({drawn_sql('i', 2)})) * cos(2 * pi() * {drawn_sql('i', 3)})) AS w FROM e), s AS (SELECT vec_id, {NORMED} AS w FROM t) {PLACES}")
def noise_gaussian(spark, d):
    return exploded(embedded(spark, d), vectors.inject_noise(F.col("v"), "gaussian_blur", 0.2, 42, F.col("vec_id")))


@query(f"WITH {VEC}, t AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN {drawn_sql('i', 1)} < 0.2 THEN 0 ELSE v[i + 1] END) AS w FROM e), s AS (SELECT vec_id, {NORMED} AS w FROM t) {PLACES}")
def noise_dropout(spark, d):
    return exploded(embedded(spark, d), vectors.inject_noise(F.col("v"), "dropout_noise", 0.2, 42, F.col("vec_id")))


@query(f"WITH {VEC}, s AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN {drawn_sql('i')} < 0.8 THEN v[i + 1] / 0.8 ELSE 0 END) AS w FROM e) {PLACES}")
def dropout(spark, d):
    return exploded(embedded(spark, d), pipeline.run(pipeline.compiled(["dropout"]), F.col("v"), 42, F.col("vec_id")))


@query(f"""WITH {VEC}, a AS (SELECT *, (vec_id % 10) / 10.0 AS u, list_sum(list_transform(v[1:20], lambda z: abs(z))) AS h, list_sum(list_transform(v, lambda z: abs(z))) AS t FROM e), b AS (SELECT *, CASE WHEN u < h / t THEN 0 ELSE 1 END AS result FROM a),
s AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN (i < 20) = (result = 0) THEN v[i + 1] / CASE WHEN result = 0 THEN h ELSE t - h END ELSE 0 END) AS w FROM b) {PLACES}""")
def collapse(spark, d):
    e = embedded(spark, d).withColumn("c", vectors.collapse(F.col("v"), 20, F.col("vec_id") % 10 / 10.0))
    return exploded(e, F.col("c.vec"))


@query(f"WITH {VEC}, a AS (SELECT *, (vec_id % 10) / 10.0 AS u, list_sum(list_transform(v[1:20], lambda z: abs(z))) AS h, list_sum(list_transform(v, lambda z: abs(z))) AS t FROM e) SELECT vec_id, CASE WHEN u < h / t THEN 0 ELSE 1 END AS result FROM a")
def collapse_result(spark, d):
    return embedded(spark, d).select("vec_id", vectors.collapse(F.col("v"), 20, F.col("vec_id") % 10 / 10.0)["result"].alias("result"))


@query("SELECT n_nationkey // 7 AS block, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, count(*) AS size FROM nation GROUP BY 1 UNION ALL SELECT -1, string_agg(n_name, ',' ORDER BY n_nationkey), count(*) FROM nation")
def chunks_merged(spark, d):
    """Blocks of seven, and all of them put together again."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    blocks = vectors.row_blocks(n, "n_nationkey", 7).groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("v"))
    both = blocks.unionByName(vectors.merged_blocks(blocks, "block", "v").withColumn("block", F.lit(-1).cast("long")))
    return both.select("block", F.array_join("v", ",").alias("names"), F.size("v").cast("long").alias("size"))


# ---- recurrences and the model shield -------------------------------------------------------------------------


@query(f"WITH RECURSIVE {X}, go AS (SELECT user_id, event_id, idx, 0.05 * coalesce(x, 0.0) AS s FROM x WHERE idx = 0 UNION ALL SELECT n.user_id, n.event_id, n.idx, 0.95 * g.s + 0.05 * coalesce(n.x, 0.0) FROM go g JOIN x n ON n.user_id = g.user_id AND n.idx = g.idx + 1) SELECT user_id, event_id, round(s * 0.7310585786, 6) AS state_scaled FROM go")
def scenario_ema(spark, d):
    # scaled, since early states are short decimals that fall on the border of a rounding
    return stabilize.scenarios(corrupted(spark, d)).select(*KEY, F.round(F.col("state") * 0.7310585786, 6).alias("state_scaled"))


@query(f"WITH {VEC}, s AS (SELECT vec_id, list_transform(range(1, 65), lambda n: list_sum(list_transform(range(1, n + 1), lambda i: 0.05 * v[i] * pow(0.95, n - i)))) AS w FROM e) {PLACES}")
def scenario_states(spark, d):
    return exploded(embedded(spark, d), stabilize.scenario_states(F.col("v")))


def step_sql(p: str, vol: str, m: str, x: str, c: stabilize.Stabilizer, table_: str, rest: str) -> str:
    """Chained tables that end in one with columns y (output), vol2 and m2."""
    usual = E.ALPHA + E.SIGMA
    return f"""SELECT {rest}, y, vol2, {1 - 1 / (max(c.radius, 1) + 1)!r} * {m} + {1 / (max(c.radius, 1) + 1)!r} * y AS m2 FROM (
SELECT *, {c.blend!r} * y0 + {1 - c.blend!r} * (local * y0 + (1 - local) * y0 * CASE WHEN diff > lim OR miss THEN 0.7 * sqrt({p} * {p} + 1e-7) / (sqrt(y0 * y0 + 1e-7) + 1e-7) + 0.3 ELSE 1 END) AS y FROM (
SELECT *, (1 - k) * {p} + k * xx AS y0 FROM (SELECT *, (1 - st) * calm + st * wild AS k FROM (
SELECT *, CASE WHEN miss THEN 1.0 ELSE least(greatest((diff - lim) / (lim + 1e-7), 0), 1) END AS st,
 least(greatest((least(greatest(1 - diff / 2, 0), 1) + local) / 2 * {usual!r} / ({usual!r} + vol2 + 1e-7), {E.GAIN_LOW!r}), {E.GAIN_HIGH!r}) AS calm,
 least(greatest(reach / (reach + diff + 1e-7), {c.k_min!r}), {c.k_max!r}) AS wild FROM (
SELECT *, {c.threshold!r} + {c.sigma_mult!r} * vol2 AS lim, {E.C_ANOMALY!r} * greatest(abs({p}), 1e-8) AS reach FROM (
SELECT *, {1 - c.alpha!r} * {vol} + {c.alpha!r} * diff AS vol2, least(greatest(1 - abs(xx - {m}) / (2 * greatest(abs({m}), 1e-3)), 0), 1) AS local FROM (
SELECT *, abs(xx - {p}) AS diff FROM (SELECT *, {x} IS NULL AS miss, coalesce({x}, {p}) AS xx FROM {table_}))))))))"""


_CONF = stabilize.Stabilizer()


@query(f"""WITH RECURSIVE {X}, go AS (SELECT user_id, event_id, idx, coalesce(x, 0.0) AS p, 0.0::DOUBLE AS vol, coalesce(x, 0.0) AS m FROM x WHERE idx = 0
UNION ALL {step_sql('p', 'vol', 'm', 'x', _CONF, '(SELECT n.user_id, n.event_id, n.idx, n.x, g.p, g.vol, g.m FROM go g JOIN x n ON n.user_id = g.user_id AND n.idx = g.idx + 1)', 'user_id, event_id, idx').replace(', y, vol2, ', ', y AS p, vol2 AS vol, ', 1).replace(' AS m2 FROM', ' AS m FROM', 1)})
SELECT user_id, event_id, round(p, 4) AS filtered FROM go""")
def stabilize_1d(spark, d):
    return stabilize.stabilize_stream(corrupted(spark, d)).select(*KEY, r6("filtered", 4))


def fold_sql(name: str, source: str, key: str, c: stabilize.Stabilizer, thr: str = "thr", batch: bool = True, hard: str = "false", grid: bool = False) -> str:
    """A recursive table (key, idx, p): the filter over `source` (key, idx, x, and columns that thr and hard name).
    grid: with l and u, the values to the left and above. batch: the first point is filtered like any other."""
    usual, a = E.ALPHA + E.SIGMA, 1 / (max(c.radius, 1) + 1)
    extra = ", ".join([w for w in (thr, hard) if w.isidentifier() and w != "false"] + (["l", "u"] if grid else []))
    extra = f", {extra}" if extra else ""
    diff, coherence = ("dt / 2 + dl / 4 + du / 4", "0.4 * (1 - dt / 2) + 0.3 * (1 - dl / 2) + 0.3 * (1 - du / 2)") if grid else ("dt", "1 - dt / 2")
    sides = ", abs(xx - coalesce(l, p)) AS dl, abs(xx - coalesce(u, p)) AS du" if grid else ""

    def step(rows: str) -> str:
        return f"""SELECT {key}, idx, y AS p, v2 AS vol, {1 - a!r} * m + {a!r} * y AS m FROM (
SELECT *, {c.blend!r} * y0 + {1 - c.blend!r} * (local * y0 + (1 - local) * y0 * CASE WHEN diff > lim OR miss THEN 0.7 * sqrt(p * p + 1e-7) / (sqrt(y0 * y0 + 1e-7) + 1e-7) + 0.3 ELSE 1 END) AS y FROM (
SELECT *, (1 - k) * p + k * xx AS y0 FROM (SELECT *, (1 - st) * calm + st * wild AS k FROM (
SELECT *, CASE WHEN miss THEN 1.0 ELSE least(greatest((diff - lim) / (lim + 1e-7), 0), 1) END AS st,
 least(greatest((coh + local) / 2 * {usual!r} / ({usual!r} + v2 + 1e-7), {E.GAIN_LOW!r}), {E.GAIN_HIGH!r}) AS calm,
 least(greatest(reach / (reach + diff + 1e-7), CASE WHEN {hard} THEN 0.0 ELSE {c.k_min!r} END), {c.k_max!r}) AS wild FROM (
SELECT *, {thr} + {c.sigma_mult!r} * v2 AS lim, {E.C_ANOMALY!r} * greatest(abs(p), 1e-8) AS reach FROM (
SELECT *, {1 - c.alpha!r} * vol + {c.alpha!r} * diff AS v2, least(greatest(1 - abs(xx - m) / (2 * greatest(abs(m), 1e-3)), 0), 1) AS local FROM (
SELECT *, {diff} AS diff, least(greatest({coherence}, 0), 1) AS coh FROM (
SELECT *, abs(xx - p) AS dt{sides} FROM (SELECT *, x IS NULL AS miss, coalesce(x, p) AS xx FROM ({rows}))))))))))"""

    begin = f"SELECT {key}, idx, x{extra}, coalesce(x, 0.0) AS p, 0.0::DOUBLE AS vol, coalesce(x, 0.0) AS m FROM {source} WHERE idx = 0"
    first = step(begin) if batch else f"SELECT {key}, idx, p, vol, m FROM ({begin})"
    return f"{name} AS ({first} UNION ALL {step(f'SELECT n.{key}, n.idx, n.x' + extra.replace(', ', ', n.') + f', g.p, g.vol, g.m FROM {name} g JOIN {source} n ON n.{key} = g.{key} AND n.idx = g.idx + 1')})"


def calibrated_sql(source: str, key: str | None, least: float) -> str:
    """(key, thr) over the values of `source`."""
    k = f"{key}, " if key else ""
    thr = f"CASE WHEN max(dd) IS NULL THEN {least!r} WHEN max(dd) > 3 AND max(dd) / (avg(dd) + 1e-5) > 5 THEN 1e-5 ELSE 0.1 * stddev_pop(x) END AS thr"
    return f"SELECT {k}{thr} FROM (SELECT {k}x, abs(x - lag(x) OVER (PARTITION BY {key or 'vec_id'} ORDER BY idx)) AS dd FROM {source}){f' GROUP BY {key}' if key else ''}"


_GRID = stabilize.PRESETS["balanced_v2"]


@query(f"""WITH RECURSIVE {VEC}, raw AS (SELECT vec_id, unnest(range(0, 64)) AS idx, unnest(v) AS y FROM e), g0 AS (SELECT vec_id, idx, CASE WHEN (7 * vec_id + 11 * idx) % 29 = 0 THEN NULL ELSE y END AS x FROM raw),
g1 AS (SELECT *, CASE WHEN idx % 8 = 0 THEN x ELSE lag(x, 1) OVER o END AS l, CASE WHEN idx < 8 THEN x ELSE lag(x, 8) OVER o END AS u FROM g0 WINDOW o AS (PARTITION BY vec_id ORDER BY idx)),
cal AS MATERIALIZED ({calibrated_sql('g0', None, _GRID.threshold)}), src AS MATERIALIZED (SELECT g1.*, thr FROM g1, cal), {fold_sql('go', 'src', 'vec_id', _GRID, grid=True)}
SELECT vec_id, idx AS pos, round(p, 6) AS filtered FROM go""")
def stabilize_2d(spark, d):
    """Vectors as grids of 8 by 8 with missing values, also beside each other and on the borders."""
    e = embedded(spark, d).select("vec_id", F.posexplode("v").alias("pos", "value"))
    e = e.withColumn("value", F.when((7 * F.col("vec_id") + 11 * F.col("pos")) % 29 != 0, F.col("value")))
    out = stabilize.stabilize_batch(Series.of(e, "vec_id", "pos"), _GRID, width=8)
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("filtered"))


@query(f"""WITH RECURSIVE {X}, go AS (SELECT user_id, event_id, idx, coalesce(x, 0.0) AS p, 0.0::DOUBLE AS vol FROM x WHERE idx = 0
UNION ALL SELECT user_id, event_id, idx, p + CASE WHEN x IS NULL THEN 0 WHEN d > 0.15 + v2 THEN 0.85 ELSE 0.10 END * (xx - p), v2 FROM (SELECT *, 0.95 * vol + 0.05 * d AS v2 FROM (SELECT *, abs(xx - p) AS d FROM (SELECT n.*, coalesce(n.x, g.p) AS xx, g.p, g.vol FROM go g JOIN x n ON n.user_id = g.user_id AND n.idx = g.idx + 1))))
SELECT user_id, event_id, round(p * 0.7310585786, 4) AS damped_scaled FROM go""")
def simple_damping(spark, d):
    # scaled as in scenario_ema
    return stabilize.simple_damping(corrupted(spark, d)).select(*KEY, F.round(F.col("damped") * 0.7310585786, 4).alias("damped_scaled"))


@query(f"WITH {X}, a AS (SELECT user_id, x, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dd FROM x), g AS (SELECT user_id, stddev_pop(x) AS s, max(dd) AS mx, avg(dd) AS mn FROM a GROUP BY user_id) SELECT user_id, round(CASE WHEN mx IS NULL THEN 1e-5 WHEN mx > 3 AND mx / (mn + 1e-5) > 5 THEN 1e-5 ELSE 0.1 * s END, 6) AS thr, round(1 / (1 + s), 6) AS noise_scalar, coalesce(mx > 3 AND mx / (mn + 1e-5) > 5, false) AS panic FROM g")
def calibrate(spark, d):
    return stabilize.calibrate(corrupted(spark, d), by=("user_id",)).select("user_id", r6("thr"), r6("noise_scalar"), "panic")


@query(f"WITH {X}, a AS (SELECT *, coalesce(x, median(x) OVER (PARTITION BY user_id), 0) AS v FROM x), b AS (SELECT *, quantile_cont(v, 0.5) {over(3, 3)} AS med FROM a), c AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY user_id) AS mad FROM b) SELECT user_id, event_id, round(CASE WHEN abs(v - med) > 6 * 1.4826 * CASE WHEN mad = 0 THEN 1e-12 ELSE mad END THEN med ELSE v END, 6) AS pre FROM c")
def blind_preclean(spark, d):
    return shield.preclean(corrupted(spark, d)).select(*KEY, r6("pre"))


@query(f"WITH {X}, a AS (SELECT *, CASE WHEN given <> 0 THEN pow(10, -4 - greatest(log10(abs(given) + 1e-15), -4)) ELSE 1 END AS factor FROM x) SELECT user_id, event_id, round(factor, 9) AS factor, round(given * factor, 9) AS clean_c, round(CASE WHEN x IS NOT NULL THEN least(greatest(x * factor, -0.002), 0.002) END, 9) AS corrupted_c, coalesce(abs(x - given) > 0.05, false) AS hard FROM a")
def shield_compress(spark, d):
    return shield.compressed(corrupted(spark, d).df, "given").select(*KEY, r6("factor", 9), r6("clean_c", 9), r6("corrupted_c", 9), "hard")


def _model(batches: pd.Series) -> pd.Series:
    return np.tanh(batches / 500)


_SHIELD = stabilize.Stabilizer(threshold=0.15, alpha=0.05)
# From `withref` (with columns x and ref) to `guarded`, with columns protected and margin_in.
GUARD = f"""sc0 AS MATERIALIZED (SELECT *, CASE WHEN ref <> 0 THEN pow(10, -4 - greatest(log10(abs(ref) + 1e-15), -4)) ELSE 1 END AS factor, coalesce(abs(x - ref) > 0.05, false) AS hard FROM withref),
sc1 AS MATERIALIZED (SELECT user_id, idx, ref * factor AS clean_c, CASE WHEN x IS NOT NULL THEN least(greatest(x * factor, -0.002), 0.002) END AS x, hard FROM sc0),
cal1 AS MATERIALIZED ({calibrated_sql('sc1', 'user_id', 0.15)}), src1 AS MATERIALIZED (SELECT sc1.*, thr FROM sc1 JOIN cal1 USING (user_id)), {fold_sql('go1', 'src1', 'user_id', _SHIELD, hard='hard')},
guarded AS MATERIALIZED (SELECT *, coalesce(abs(x - protected), abs(protected)) AS margin_in FROM (SELECT sc0.*, (p - CASE WHEN sc0.hard THEN 0.99 ELSE 0.85 END * (p - clean_c)) / factor AS protected FROM sc0 JOIN sc1 USING (user_id, idx) JOIN go1 USING (user_id, idx)))"""
# From `answered` (with columns output and output_ref) to `shielded` and margin_out.
ANSWER = f"""aa AS (SELECT *, abs(output - output_ref) AS d FROM answered), ab AS (SELECT *, least(greatest(1 - d / (2 * greatest(abs(output), 1e-3)), 0), 1) AS near FROM aa),
ac AS (SELECT *, least(greatest((1 - near) * {GAIN.format(d='d')} * {E.K_MAX!r} + near * least(greatest(0.25 + d / ({E.C_ANOMALY!r} + d + 1e-7) * ({E.K_MAX!r} - 0.25), 0.25), {E.K_MAX!r}), {E.GAIN_LOW!r}), {E.GAIN_HIGH!r}) AS k FROM ab),
fin AS (SELECT *, (1 - k) * output + k * output_ref AS shielded, abs(output - ((1 - k) * output + k * output_ref)) AS margin_out FROM ac)"""


def _model(batches: pd.Series) -> pd.Series:
    return np.tanh(batches / 500)


@query(f"""WITH RECURSIVE {X}, pa AS (SELECT *, coalesce(x, median(x) OVER (PARTITION BY user_id), 0) AS v FROM x), pb AS (SELECT *, quantile_cont(v, 0.5) {over(3, 3)} AS med FROM pa), pc AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY user_id) AS mad FROM pb),
src0 AS MATERIALIZED (SELECT user_id, idx, CASE WHEN abs(v - med) > 6 * 1.4826 * CASE WHEN mad = 0 THEN 1e-12 ELSE mad END THEN med ELSE v END AS x FROM pc), {fold_sql('go0', 'src0', 'user_id', _SHIELD, thr='0.15', batch=False)},
withref AS MATERIALIZED (SELECT x.*, p AS ref FROM x JOIN go0 USING (user_id, idx)), {GUARD},
out0 AS MATERIALIZED (SELECT *, tanh(protected / 500) AS output FROM guarded), so AS MATERIALIZED (SELECT user_id, idx, output AS x FROM out0), cal2 AS MATERIALIZED ({calibrated_sql('so', 'user_id', 0.15)}), src2 AS MATERIALIZED (SELECT so.*, thr FROM so JOIN cal2 USING (user_id)), {fold_sql('go2', 'src2', 'user_id', _SHIELD)},
answered AS (SELECT out0.*, p AS output_ref FROM out0 JOIN go2 USING (user_id, idx)), {ANSWER}
SELECT user_id, event_id, round(protected, 4) AS protected, round(margin_in, 4) AS margin_in, round(shielded, 6) AS shielded, round(margin_out, 6) AS margin_out FROM fin""")
def shield_full(spark, d):
    """Blind protection around a pandas model."""
    model = F.pandas_udf(_model, "double")
    out = shield.ModelShield(model).protect(corrupted(spark, d))
    return out.select(*KEY, r6("protected", 4), r6("margin_in", 4), r6("shielded"), r6("margin_out"))


@query(f"""WITH RECURSIVE {X}, withref AS MATERIALIZED (SELECT *, coalesce(given, 0.0) AS ref FROM x), {GUARD}, answered AS (SELECT *, 2 * protected + 1 AS output, 2 * ref + 1 AS output_ref FROM guarded), {ANSWER}
SELECT round(avg(margin_in), 4) AS mean_margin_in, round(max(margin_in), 4) AS max_margin_in, round(avg(margin_out), 4) AS mean_margin_out, round(max(margin_out), 4) AS max_margin_out FROM fin""")
def shield_margins(spark, d):
    out = shield.ModelShield(lambda c: 2 * c + 1).protect(corrupted(spark, d), reference="given")
    return shield.margins(out).select(*(r6(c, 4) for c in ("mean_margin_in", "max_margin_in", "mean_margin_out", "max_margin_out")))


# ---- sources and sinks: files that the query writes itself ----------------------------------------------------


@query("SELECT * FROM (VALUES (0::BIGINT, 1.5::DOUBLE), (1, -200), (2, NULL), (3, 7), (4, 0.25)) t(idx, value)")
def read_numbers(spark, d):
    path = runtime.scratch(spark, "numbers")
    runtime.put(spark, f"{path}/series.txt", b"first 1.5, -2e2\nNaN; 7 and 0.25")
    return readers.numbers(spark, path).select("idx", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


@query("SELECT i AS idx, c AS channel, 8000 AS rate, 'int16' AS dtype, round((CASE WHEN c = 0 THEN 1000 * i ELSE -500 * i END) / 32768.0, 6)::DOUBLE AS sample FROM range(0, 20) a(i), range(0, 2) b(c)")
def read_wav(spark, d):
    path, i = runtime.scratch(spark, "wav"), np.arange(20)
    runtime.put(spark, f"{path}/tone.wav", readers.write_wav(8000, np.stack([1000 * i, -500 * i], 1).astype(np.int16)))
    return readers.wav(spark, path).select("idx", F.col("channel").cast("long").alias("channel"), "rate", "dtype", r6("sample"))


@query(f"WITH {X}, g AS (SELECT count(*) AS n, var_pop(x / 500) AS a, var_pop(given / 500) AS b FROM x) SELECT unnest(['Points: ' || n, printf('Variance, raw: %.3f', a), printf('Variance, filtered: %.3f', b), printf('Damping: %.2f%%', (a - b) / a * 100)]) AS line FROM g")
def trend_report(spark, d):
    """The lines of the report as they are read back, with fewer digits."""
    path = runtime.scratch(spark, "trend")
    pairs = corrupted(spark, d).df.select((F.col("x") / 500).alias("raw"), (F.col("given") / 500).alias("filtered"))
    reports.trend_report(spark, pairs, "raw", "filtered", path)
    line = F.col("value")
    short = F.concat(F.substring_index(line, ": ", 1), F.lit(": "), F.regexp_replace(F.format_number(F.substring_index(line, ": ", -1).cast("double"), 3), ",", ""))
    return spark.read.text(path).where(~line.startswith("Engine")).select(F.when(line.startswith("Variance"), short).otherwise(line).alias("line"))


@query("SELECT 3::BIGINT AS records, true AS intact, false AS altered_intact, 'NaN' AS missing")
def provenance_archive(spark, d):
    """An archive is intact as written, and isn't once a number in it is changed."""
    path, other = runtime.scratch(spark, "archive"), runtime.scratch(spark, "archive")
    reports.provenance(spark, [{"k": 0, "v": 1.5}, {"k": 1, "v": float("nan")}, {"k": 2, "v": [1.0, 2.0]}], path)
    text = spark.read.text(path, wholetext=True).first()["value"]
    spark.createDataFrame([(text.replace("1.5", "1.6"),)], "value string").coalesce(1).write.text(other)
    records = json.loads(text)["records"]
    return spark.createDataFrame([(len(records), reports.verified(spark, path), reports.verified(spark, other), records[1]["v"])], "records long, intact boolean, altered_intact boolean, missing string")


@query(f"SELECT * FROM (VALUES (0::BIGINT, 'relu', 0.0::DOUBLE, 0.0::DOUBLE), (1, 'scale', {E.PHI!r}, 0.25), (2, 'clip', -0.5, 0.5), (3, 'identity', 0, 0)) t(place, name, p1, p2)")
def op_list_storage(spark, d):
    path = runtime.scratch(spark, "ops")
    pipeline.save(spark, pipeline.compiled(["ReLU ", "scale", ("clip", -0.5, 0.5), "no such op"]), path)
    return spark.createDataFrame([(i, o.name, o.p1, o.p2) for i, o in enumerate(pipeline.load(spark, path))], "place long, name string, p1 double, p2 double")


@query("SELECT * FROM (VALUES ('balanced_v2', 1e-05::DOUBLE, 0.05::DOUBLE, 1.0::DOUBLE, 0.18::DOUBLE, 0.28::DOUBLE), ('cifar10_best_v1', 4.384205263047182e-06, 0.04590571010729771, 0.8, 0.19814386535420334, 0.2945784399322787), ('pure_1d_time_v1', 0.08, 0.35, 1.2, 0.25, 0.55), ('cifar10_hardened_lyapunov', 0.12, 0.05, 1.0, 0.18, 0.28)) t(name, threshold, alpha, sigma_mult, k_min, k_max)")
def presets(spark, d):
    rows = [(n, c.threshold, c.alpha, c.sigma_mult, c.k_min, c.k_max) for n, c in stabilize.PRESETS.items()]
    return spark.createDataFrame(rows, "name string, threshold double, alpha double, sigma_mult double, k_min double, k_max double")
