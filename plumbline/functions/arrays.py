"""Array expressions: order statistics, moments and histograms, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(a), F.size(a))


def std(a: Column) -> Column:
    """Population standard deviation; null for an empty array."""
    return let(mean(a), lambda m: F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(a))))


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics; null for an empty array."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(float(q))
        low = F.floor(at).cast("int")
        first = F.element_at(s, low + 1)
        return first + (at - low) * (F.element_at(s, F.least(low + 2, F.size(s))) - first)

    return F.when(F.size(a) > 0, let(F.array_sort(a), of))


def median(a: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.size(s)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2

    return F.when(F.size(a) > 0, let(F.array_sort(a), of))


def deviations(a: Column, centre: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x - centre))


def clipped(a: Column, n_sigmas: float, rounds: int) -> Column:
    """Members within n_sigmas of the mean of members, again and again; each round looks at all of `a`.

    It stays as it is once fewer than two members are left or they don't vary.
    """

    def step(kept: Column, _: Column) -> Column:
        return let(F.struct(mean(kept).alias("m"), std(kept).alias("s")), lambda c: F.when((F.size(kept) < 2) | (c["s"] < 1e-12), kept).otherwise(F.filter(a, lambda x: F.abs(x - c["m"]) <= n_sigmas * c["s"])))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), a, step)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def histogram(a: Column, low: Column, high: Column, bins: Column) -> Column:
    """Counts in equal bins; each holds its lower edge and the last its upper edge too."""

    def count(k: Column) -> Column:
        lower, upper = low + k * ((high - low) / bins), low + (k + 1) * ((high - low) / bins)
        return F.size(F.filter(a, lambda x: (x >= lower) & ((x < upper) | (k == bins - 1)))).cast("double")

    return F.transform(F.sequence(F.lit(0), bins - 1), count)


def jensen_shannon(a: Column, b: Column, pseudo: float = 1.0) -> Column:
    """Divergence in bits of two samples over shared bins, about six values to a bin, `pseudo` added to each count."""

    def divergence(c: Column) -> Column:
        def share(counts: Column) -> Column:
            return let(total(counts), lambda t: F.transform(counts, lambda x: x / t))

        p = share(F.transform(histogram(a, c["low"], c["high"], c["bins"]), lambda x: x + pseudo))
        q = share(F.transform(histogram(b, c["low"], c["high"], c["bins"]), lambda x: x + pseudo))
        return let(
            F.struct(p.alias("p"), q.alias("q")),
            lambda s: 0.5 * total(F.zip_with(s["p"], s["q"], lambda x, y: x * F.log2(x / (0.5 * (x + y))))) + 0.5 * total(F.zip_with(s["p"], s["q"], lambda x, y: y * F.log2(y / (0.5 * (x + y))))),
        )

    bounds = F.struct(
        F.least(F.array_min(a), F.array_min(b)).alias("low"),
        F.greatest(F.array_max(a), F.array_max(b)).alias("high"),
        F.greatest(F.lit(3), F.least(F.lit(10), F.floor((F.size(a) + F.size(b)) / 6).cast("int"))).alias("bins"),
    )
    return let(bounds, lambda c: F.when(c["high"] - c["low"] < 1e-12, F.lit(0.0)).otherwise(divergence(c)))
