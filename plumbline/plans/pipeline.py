"""Op lists compiled to one expression over an array column; Catalyst does the rest."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions.elementwise import PHI, clip, sigmoid, uniform

#: Defaults of ops given by name alone.
DEFAULTS = {"dropout": (0.8, 0.0), "clip": (-1.0, 1.0), "scale": (PHI, 0.25)}
NAMES = ("identity", "relu", "sigmoid", "tanh", "scale", "dropout", "clip", "l2_normalize")
LOSS_SCALE = PHI**4


@dataclass(frozen=True)
class Op:
    name: str
    p1: float = 0.0
    p2: float = 0.0


def compiled(instructions: Iterable) -> tuple[Op, ...]:
    """Names, or tuples of a name and up to two numbers (missing ones are 0). Unknown names do nothing."""
    out = []
    for i in instructions:
        if isinstance(i, (tuple, list)):
            name, given = str(i[0]).lower().strip(), (*map(float, i[1:3]), 0.0, 0.0)
        else:
            name = str(i).lower().strip()
            given = DEFAULTS.get(name, (0.0, 0.0))
        out.append(Op(name if name in NAMES else "identity", given[0], given[1]))
    return tuple(out)


def one(op: Op, v: Column, seed: int = 42, id_: Column | None = None) -> Column:
    if op.name == "relu":
        return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    if op.name == "sigmoid":
        return F.transform(v, sigmoid)
    if op.name == "tanh":
        return F.transform(v, F.tanh)
    if op.name == "scale":
        return F.transform(v, lambda x: x * op.p1 + op.p2)
    if op.name == "clip":
        return F.transform(v, lambda x: clip(x, op.p1, op.p2))
    if op.name == "l2_normalize":
        return A.let(v, lambda w: A.let(A.norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))
    if op.name == "dropout" and op.p1 > 0:
        row = F.lit(0) if id_ is None else id_
        return F.transform(v, lambda x, i: F.when(uniform(row, i, F.lit(seed)) < op.p1, x / op.p1).otherwise(F.lit(0.0)))
    return v


def run(ops: Iterable[Op], v: Column, seed: int = 42, id_: Column | None = None) -> Column:
    """The ops in order. Each dropout draws anew, by hashes of the id and the place."""
    v = v.cast("array<double>")
    for k, op in enumerate(ops):
        v = one(op, v, seed + k, id_)
    return v


def run_in_blocks(ops: Iterable[Op], v: Column, size: int = 500, seed: int = 42, id_: Column | None = None) -> Column:
    """The same; blocks of ops bound the size of one expression and don't change results."""
    if size < 1:
        raise ValueError("block size must be positive")
    return run(ops, v, seed, id_)


def gradient(ops: Iterable[Op], v: Column) -> Column:
    """Of the sum of squares of the result, over a fixed scale, with respect to the input.

    At kinks the slope of relu is 0 at 0 and that of clip 1 on its borders. Dropout has no place here.
    """
    ops = tuple(ops)
    if any(o.name == "dropout" for o in ops):
        raise ValueError("gradients need ops without chance")
    seen = [v.cast("array<double>")]
    for o in ops:
        seen.append(one(o, seen[-1]))
    g = F.transform(seen[-1], lambda y: 2 * y / LOSS_SCALE)
    for o, x, y in zip(reversed(ops), reversed(seen[:-1]), reversed(seen[1:]), strict=True):
        g = _back(o, g, x, y)
    return g


def _back(op: Op, g: Column, x: Column, y: Column) -> Column:
    """The gradient before an op, from that after it, its input and its output."""
    if op.name == "relu":
        return F.zip_with(g, x, lambda d, t: F.when(t > 0, d).otherwise(F.lit(0.0)))
    if op.name == "sigmoid":
        return F.zip_with(g, y, lambda d, s: d * s * (1 - s))
    if op.name == "tanh":
        return F.zip_with(g, y, lambda d, s: d * (1 - s * s))
    if op.name == "scale":
        return F.transform(g, lambda d: d * op.p1)
    if op.name == "clip":
        return F.zip_with(g, x, lambda d, t: F.when((t >= op.p1) & (t <= op.p2), d).otherwise(F.lit(0.0)))
    if op.name == "l2_normalize":
        flat = A.let(A.dot(g, y), lambda p: F.zip_with(g, y, lambda d, u: d - u * p))
        return A.let(A.norm(x), lambda n: F.when(n > 0, F.transform(flat, lambda d: d / n)).otherwise(g))
    return g


def save(spark: SparkSession, ops: Iterable[Op], path: str) -> None:
    """One JSON text file in a folder, by Spark's writer."""
    spark.createDataFrame([(json.dumps([asdict(o) for o in ops]),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> tuple[Op, ...]:
    """A missing folder raises FileNotFoundError."""
    from pyspark.errors import AnalysisException

    try:
        text = "".join(r["value"] for r in spark.read.text(path).collect())
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return tuple(Op(**o) for o in json.loads(text))
