"""Similarity of vectors to a query, and recall from a bank of clean references."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.functions import arrays as A
from plumbline.functions.elementwise import ALPHA, C_ANOMALY, EPS, GAIN_HIGH, GAIN_LOW, K_MAX, damping_blend

# Default knobs of the score.
KAPPA, STRESS = 0.86210, 9.42194e-04
#: Inputs of a shape that meet their references together, on average; and scores that are worked out at once.
BLOCK, CELLS = 512, 1 << 14


def stress_factor(stress: float = STRESS) -> float:
    """A constant of all rows: it doesn't change an order."""
    n = round(abs(stress) * 100) + 3
    n = n / 2 if n % 2 == 0 else 3 * n + 1
    gap = abs(math.log(max(n, 1e-8)) - 1)
    return 1 + (0.10 + 0.75 / (1 + math.exp(-gap))) * abs(stress)


def unit(v: Column) -> Column:
    """A vector of norm 1; null for one of norm below 1e-8."""
    return A.let(A.norm(v), lambda n: F.when(n >= 1e-8, F.transform(v, lambda x: x / n)))


def blend_weight(kappa: float = KAPPA) -> float:
    return min(0.85, max(0.10, 0.60 + 0.25 * kappa))


def resonance(vector: Column, query: Column, kappa: float = KAPPA, stress: float = STRESS) -> Column:
    """Weighted cosine of the vector, and of its blend with the query, to a query of norm 1. 0 for a null query."""
    w = blend_weight(kappa)
    cosine = lambda v: A.dot(v, query) / F.greatest(A.norm(v), F.lit(1e-8))
    blended = F.zip_with(vector, query, lambda x, q: damping_blend(x, q))
    score = ((1 - w) * cosine(vector) + w * A.let(blended, cosine)) * stress_factor(stress)
    return F.when(query.isNull(), F.lit(0.0)).otherwise(score)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def scores(table: DataFrame, query: DataFrame, vector: str = "embedding", kappa: float = KAPPA, stress: float = STRESS) -> DataFrame:
    """Adds `score` of every row against the one row of `query` (column `query`), which is broadcast. A query table
    of more rows is an error; of none, there are no scores."""
    found = query.select(F.struct(doubles(F.col("query")).alias("q")).alias("s")).limit(2).agg(F.collect_list("s").alias("qs")).where(F.size("qs") > 0)
    alone = F.when(F.size("qs") == 1, F.element_at("qs", 1)["q"]).otherwise(F.raise_error(F.lit("one query at a time")).cast("array<double>"))
    one = found.select(unit(alone).alias("_q"))
    return table.crossJoin(F.broadcast(one)).withColumn("score", resonance(doubles(F.col(vector)), F.col("_q"), kappa, stress)).drop("_q")


def top(table: DataFrame, query: DataFrame, k: int = 1, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    return scores(table, query, vector).orderBy(F.desc("score"), tie).limit(k)


def remembered(bank: DataFrame, most: int = 32, shape: str = "shape", seq: str = "seq") -> DataFrame:
    """The last `most` references of each shape."""
    newest = F.row_number().over(Window.partitionBy(shape).orderBy(F.desc(seq)))
    return bank.withColumn("_n", newest).where(F.col("_n") <= most).drop("_n")


def _resonances(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """`resonance` of each of `queries` (rows) with each of `vectors` (columns); NaN for a vector that holds one.

    Sums go over components in order, so that equal vectors have equal scores wherever they stand."""
    x_norm, (dot, mixed_dot, mixed_norm) = np.zeros(len(vectors)), np.zeros((3, len(queries), len(vectors)))
    for x, q in zip(np.ascontiguousarray(vectors.T), np.ascontiguousarray(queries.T)[:, :, None]):
        d = np.abs(x - q)
        near = np.clip(1 - d / (2 * np.maximum(np.abs(x), 1e-3)), 0, 1)
        steer = 1 / (1 + np.exp(-(np.minimum(d, 5) - 2))) * K_MAX
        anomalous = np.clip(ALPHA + d / (C_ANOMALY + d + EPS) * (K_MAX - ALPHA), ALPHA, K_MAX)
        k = np.clip((1 - near) * steer + near * anomalous, GAIN_LOW, GAIN_HIGH)
        mixed = (1 - k) * x + k * q
        x_norm += x * x
        dot += x * q
        mixed_dot += mixed * q
        mixed_norm += mixed * mixed
    w = blend_weight()
    return ((1 - w) * (dot / np.maximum(np.sqrt(x_norm), 1e-8)) + w * (mixed_dot / np.maximum(np.sqrt(mixed_norm), 1e-8))) * stress_factor()


def _by_length(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the lists of each length; a missing component is NaN, missing lists are left out."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    places = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes[sizes >= 0])}
    return {n: (at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)) for n, at in places.items()}


def _best(asked: pa.Array, refs: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the best reference of each query, the first of equal ones, and its score; -1 and NaN for none."""
    place, score = np.full(len(asked), -1), np.full(len(asked), np.nan)
    if refs:
        null = asked.is_null().to_numpy(zero_copy_only=False)
        place[null], score[null] = min(at[0] for at, _ in refs.values()), 0.0
    with np.errstate(all="ignore"):
        for n, (mine, queries) in _by_length(asked).items():
            at, vectors = refs.get(n, ([], None))
            step = max(1, CELLS // max(1, len(at)))
            for i in range(0, len(mine) if len(at) else 0, step):
                s = _resonances(vectors, queries[i : i + step])
                s = np.where(np.isnan(s), -np.inf, s)
                first = s.argmax(1)
                top = s[np.arange(len(s)), first]
                some = top > -np.inf
                place[mine[i : i + step][some]], score[mine[i : i + step][some]] = at[first[some]], top[some]
    return place, score


def recall(inputs: DataFrame, bank: DataFrame, least: float = 0.90, most: int = 32, key: str = "id", shape: str = "shape", vector: str = "vec", seq: str = "seq") -> DataFrame:
    """(key, recalled, score, reference): the best of the last `most` references of the same shape, the earliest of
    equal ones; null below `least`. A score that isn't a number recalls nothing. At most `most` rows per input. Inputs
    of a shape are dealt in parts of about BLOCK, each with a copy of the shape's references, so that few shapes are no
    few tasks; shapes of more inputs than that are looked up by broadcast. A part is scored as matrices."""
    refs = remembered(bank, most, shape, seq).select(shape, F.col(seq).alias("_seq"), doubles(F.col(vector)).alias("_vec"), F.lit(False).alias("_asked"))
    asked = inputs.select(key, shape, unit(doubles(F.col(vector))).alias("_vec"), F.lit(True).alias("_asked"))
    met = asked.unionByName(refs.where(F.col(shape).isNotNull() & F.col("_vec").isNotNull()), allowMissingColumns=True)
    large = inputs.groupBy(F.col(shape).alias("_shape")).agg(F.ceil(F.count("*") / BLOCK).alias("_parts")).where("_parts > 1")
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    part = F.when(F.col("_asked"), F.array(F.pmod(F.xxhash64(key), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    met = met.join(F.broadcast(large), F.col(shape).eqNullSafe(F.col("_shape")), "left").select(key, shape, "_seq", "_vec", "_asked", F.explode(part).alias("_part"))
    met = met.repartition(int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shape, "_part")
    in_order = Window.partitionBy(shape, "_part").orderBy("_asked", F.asc_nulls_last("_seq"))
    met = met.withColumn("_at", F.row_number().over(in_order)).select(key, "_seq", "_vec", "_asked", "_at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, refs = [], None
        for batch in batches:
            ask, begins = batch.column("_asked").to_numpy(zero_copy_only=False), batch.column("_at").to_numpy() == 1
            for i, j in pairwise([*np.flatnonzero(begins | np.diff(ask, prepend=not ask[:1].any())), len(ask)]):
                rows = batch.slice(i, j - i)
                if begins[i]:
                    held, refs = [batch.slice(0, 0)], None
                if not ask[i]:
                    held.append(rows)
                    continue
                if refs is None:
                    seqs, vectors = (pa.concat_arrays([b.column(c) for b in held]) for c in ("_seq", "_vec"))
                    refs = _by_length(vectors)
                place, score = _best(rows.column("_vec"), refs)
                good = pa.array(place, mask=~(score >= least))
                yield pa.RecordBatch.from_arrays([rows.column(key), seqs.take(good), vectors.take(good), pa.array(score, mask=place < 0)], [key, "_seq", "_ref", "_score"])

    fields = met.schema
    out = StructType([fields[key], StructField("_seq", fields["_seq"].dataType), StructField("_ref", fields["_vec"].dataType), StructField("_score", DoubleType())])
    best = met.mapInArrow(run, out).groupBy(key).agg(F.max_by(F.struct("_seq", "_ref", "_score"), F.struct("_score", -F.col("_seq"))).alias("b"))
    return best.select(key, F.col("b._seq").alias("recalled"), F.col("b._score").alias("score"), F.col("b._ref").alias("reference"))
