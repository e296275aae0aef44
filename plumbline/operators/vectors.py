"""Operators on vectors kept in array columns: permutation, noise, decision, patching, blocks, transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions.elementwise import uniform
from plumbline.runtime import scratch


def bit_swap(v: Column, bits: int, target: int, control: int) -> Column:
    """Where the control bit of a place is set, its target bit is flipped; bits count from the highest."""
    t, c = 1 << (bits - 1 - target), 1 << (bits - 1 - control)
    if t == c:
        return v
    places = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    return F.transform(places, lambda i: F.element_at(v, F.when(i.bitwiseAND(c) != 0, i.bitwiseXOR(t)).otherwise(i) + 1))


def curvature(current: Column, reference: Column, delta: float = 1e-6) -> Column:
    s = A.total(F.zip_with(current, reference, lambda a, b: 4 * (a - b) * (a - b)))
    return F.sqrt(s + delta) / F.sqrt(1 + s + delta)


def l2_normalized(v: Column) -> Column:
    return A.let(A.norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def inject_noise(v: Column, kind: str, intensity: float, seed: int = 42, id_: Column | None = None) -> Column:
    """Signs flipped, values dropped, or normal noise added, each with chance (or deviation) `intensity`; then the
    vector gets norm 1. No intensity, or `clean`, changes nothing; unknown kinds only set the norm.

    Draws are hashes of the id, the place and the seed, so they repeat however the rows are partitioned.
    """
    kind = kind.lower().strip()
    if intensity <= 0 or kind == "clean":
        return v
    row = F.lit(0) if id_ is None else id_
    drawn = lambda i, salt: uniform(row, i, F.lit(seed), F.lit(salt))
    hit = lambda i: drawn(i, 1) < float(intensity)
    if kind == "bitflip":
        out = F.transform(v, lambda x, i: F.when(hit(i), -x).otherwise(x))
    elif kind == "dropout_noise":
        out = F.transform(v, lambda x, i: F.when(hit(i), F.lit(0.0)).otherwise(x))
    elif kind == "gaussian_blur":
        out = F.transform(v, lambda x, i: x + float(intensity) * F.sqrt(-2 * F.log(drawn(i, 2))) * F.cos(2 * math.pi * drawn(i, 3)))
    else:
        out = v
    return A.let(out, lambda o: A.let(A.norm(o), lambda n: F.when(n > 0, F.transform(o, lambda x: x / (n + 1e-15))).otherwise(o)))


def collapse(v: Column, target: int, u: Column) -> Column:
    """struct(result, vec): the head (before `target`) or tail is kept, by chance in proportion to its absolute sum,
    and scaled to an absolute sum of 1. u: a number from 0 to 1 that decides. A vector without energy is an error."""
    head = F.slice(v, 1, target) if target > 0 else F.array().cast("array<double>")
    absolute = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))

    def decided(t: Column) -> Column:
        result = F.when(u < t["h"] / (t["h"] + t["t"]), 0).otherwise(1)
        kept = F.transform(v, lambda x, i: F.when((i < target) == (result == 0), x).otherwise(F.lit(0.0)))
        kept_sum = F.when(result == 0, t["h"]).otherwise(t["t"])
        vec = F.when(kept_sum > 0, F.transform(kept, lambda x: x / kept_sum)).otherwise(kept)
        return F.struct(result.alias("result"), vec.alias("vec"))

    sums = F.struct(absolute(head).alias("h"), (absolute(v) - absolute(head)).alias("t"))
    failed = F.raise_error(F.lit("a vector without energy decides nothing")).cast("struct<result:int,vec:array<double>>")
    return A.let(sums, lambda t: F.when(t["h"] + t["t"] < 1e-12, failed).otherwise(decided(t)))


def patched(template: DataFrame, params: DataFrame, key: str, order: str, op: str = "op", value: str = "value") -> DataFrame:
    """(key, order, op, patched): each -1 of a template takes the next parameter of its key, in order; one that finds
    none left takes the last."""
    over = Window.partitionBy(key).orderBy(order)
    t = template.withColumn("_i", F.sum(F.when(F.col(op) == -1, 1).otherwise(0)).over(over))
    p = params.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_p"))  # parameters of one template
    taken = F.get("_p", (F.least(F.col("_i"), F.size("_p")) - 1).cast("int"))[value]
    return t.join(p, key, "left").select(key, order, op, F.when(F.col(op) == -1, taken).otherwise(F.col(op)).alias("patched"))


def row_blocks(df: DataFrame, order: str, size: int, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds `block`: rows in order, `size` to a block, the last one short. Without a key rows are sorted over all tasks
    and numbered from the counts of these; rows that tie in order are interchangeable."""
    if size < 1:
        raise ValueError("block size must be positive")
    if key:
        return df.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1) / size))
    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    path = scratch(df.sparkSession, "blocks")  # written once, so that counts and places are of one and the same sorting
    sorted_.write.parquet(path)
    rows = df.sparkSession.read.schema(sorted_.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # one row a task
    return rows.join(F.broadcast(bases), "_part").withColumn("block", F.floor((F.col("_base") + F.col("_at")) / size)).drop("_id", "_part", "_at", "_base")


def merged_blocks(df: DataFrame, order: str, values: str) -> DataFrame:
    """(values): the arrays of all blocks end to end, by `order`, for blocks that fit one row together."""
    return df.groupBy().agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v")))), lambda b: b["v"])).alias(values))


#: The static transforms, row by row.
STATIC = {
    "invert": [[0.0, 1.0], [1.0, 0.0]],
    "identity": [[1.0, 0.0], [0.0, 1.0]],
    "edge_detector": [[-1.0, 2.0, -1.0]],
    "blend": [[0.5, 0.5], [0.5, 0.5]],
}


def static_transform(name: str) -> list[list[float]]:
    if name.lower() not in STATIC:
        raise KeyError(f"no static transform {name!r}; there are {', '.join(STATIC)}")
    return STATIC[name.lower()]


def parametric_transform(name: str, p: float) -> list[list[float]]:
    made = {"scale_project": [[math.cos(p), -math.sin(p)], [math.sin(p), math.cos(p)]], "amplify": [[p, 0.0], [0.0, p]], "bias_shift": [[p, -p]]}
    if name.lower() not in made:
        raise KeyError(f"no parametric transform {name!r}; there are {', '.join(made)}")
    return made[name.lower()]


def applied(matrix: list[list[float]], v: Column) -> Column:
    """The matrix times a vector."""
    return F.array(*[A.dot(F.array(*map(F.lit, row)), v) for row in matrix])


def backend_info(spark) -> str:
    return f"Spark {spark.version}, double precision, {spark.sparkContext.defaultParallelism} tasks at a time"
