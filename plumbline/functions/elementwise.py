"""Expressions on single values: blends, gains, scales, and the integer maps. Null stands for a missing value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the gain curves.
PHI = (1 + math.sqrt(5)) / 2
ALPHA = 0.25
SIGMA = 1 / PHI**4
K_MAX = 60.16762236065194 / PHI**4
C_ANOMALY = 1 / PHI**2
EPS = 1e-7
GAIN_LOW, GAIN_HIGH = ALPHA - SIGMA, 1 - (ALPHA - SIGMA)
LOG_TARGET = -4.0
DAMPING_GATE = 0.85


def clip(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that follows from the parts alone: the first 52 bits of their MD5, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def finite(x: Column) -> Column:
    """The value as a double, or null if it is NaN or infinite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def damping_blend(raw: Column, ref: Column) -> Column:
    """Weighted mean of a value and its reference; the weight grows with their distance, between 0.104 and 0.896.

    A missing side is replaced by the other with the greatest weight; null if both are missing.
    """
    a, b = F.coalesce(raw, ref), F.coalesce(ref, raw)
    d = F.abs(a - b)
    near = clip(1 - d / (2 * F.greatest(F.abs(a), F.lit(1e-3))), 0, 1)
    steer = sigmoid(clip(d, 0, 5) - 2) * K_MAX
    anomalous = clip(ALPHA + d / (C_ANOMALY + d + EPS) * (K_MAX - ALPHA), ALPHA, K_MAX)
    k = F.when(raw.isNull() | ref.isNull(), F.lit(GAIN_HIGH)).otherwise(clip((1 - near) * steer + near * anomalous, GAIN_LOW, GAIN_HIGH))
    return (1 - k) * a + k * b


def dynamic_gain(noise: Column, low: float = 0.25, high: float = K_MAX) -> Column:
    return sigmoid(clip(noise, 0, 5) - 2) * (high - low) + low


def log_factor(v: Column) -> Column:
    """Factor that brings a positive value to 1e-4; 1 for others."""
    return F.when(v > 0, F.pow(F.lit(10.0), LOG_TARGET - F.log10(v))).otherwise(F.lit(1.0))


def log_encode(v: Column) -> Column:
    return F.when(v > 0, v * log_factor(v)).otherwise(F.lit(0.0))


def log_decode(encoded: Column, factor: Column) -> Column:
    return F.try_divide(encoded, factor)


def level_from_entropy(entropy: Column, vocabulary: Column) -> Column:
    return clip(1 - entropy / (F.log(F.greatest(vocabulary, F.lit(2)).cast("double")) + 1e-12), 0, 1)


def collatz_step(n: Column) -> Column:
    return F.when(F.pmod(n, F.lit(2)) == 0, F.floor(n / 2).cast("double")).otherwise(3.0 * n + 1)


def collatz_smooth(x: Column) -> Column:
    """The step continued to all reals: equal to it on whole numbers."""
    angle = math.pi * x / 2
    return x / 2 * F.pow(F.cos(angle), F.lit(2.0)) + (3 * x + 1) * F.pow(F.sin(angle), F.lit(2.0))


def primes_below(n: int) -> list[int]:
    return [p for p in range(2, n) if all(p % q for q in range(2, math.isqrt(p) + 1))]


def is_prime_small(n: Column, limit: int = 128) -> Column:
    """1 if n is at least 2 and no smaller number below `limit` divides it, else 0."""
    below = F.sequence(F.lit(2), F.lit(limit - 1))
    return F.when((n >= 2) & ~F.exists(below, lambda d: (d < n) & (F.pmod(n, d) == 0)), 1).otherwise(0)


def radical(n: Column, limit: int = 256) -> Column:
    """Product of the different primes below `limit` that divide n; 0 and 1 stand for themselves."""
    some = F.array(*[F.lit(float(p)) for p in primes_below(limit)])
    product = F.aggregate(F.filter(some, lambda p: (p <= n) & (F.pmod(n, p) == 0)), F.lit(1.0), lambda a, p: a * p)
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.lit(1.0)).otherwise(product)


def abc_gap(b: Column, c: Column, power: float = 1.0, smooth: bool = False) -> Column:
    """Distance of b's radical from a power of |c|; missing values count as 1. b is rounded half to even unless smooth."""
    b, c = F.coalesce(b, F.lit(1.0)), F.coalesce(c, F.lit(1.0))
    return F.abs(radical(F.abs(b if smooth else F.rint(b))) - F.pow(F.abs(c), F.lit(power)))


def gate(corrupted: Column) -> Column:
    """The same weight for every value."""
    return F.lit(DAMPING_GATE)


def gate_smooth(corrupted: Column, clean: Column) -> Column:
    """Experimental weight from 0.10 to 0.85 by the continued step of the noise; 0.85 where the value is missing."""
    value = F.coalesce(corrupted, clean)
    wave = collatz_smooth(F.abs(value - clean) * 100 + 3)
    return F.when(corrupted.isNull(), F.lit(DAMPING_GATE)).otherwise(0.10 + sigmoid(abc_gap(wave, value, smooth=True)) * (DAMPING_GATE - 0.10))


def alignment(x: Column, base: Column, gradient: Column, scale: Column) -> Column:
    """0 to 1: how far a step goes with the trend, and stays within the usual scale of steps."""
    d = x - base
    sign = F.when((F.abs(d) > 1e-12) & (F.abs(gradient) > 1e-12), F.signum(d) * F.signum(gradient)).otherwise(F.lit(0.0))
    return clip(0.6 * (sign + 1) / 2 + 0.4 * (1 - F.abs(d) / scale), 0, 1)


def drive(before: Column, after: Column, phi: Column) -> Column:
    """5 times the clipped log of the energies' ratio, weighted; 0 if either is as good as nothing."""
    ratio = F.when((before > 1e-12) & (after > 1e-12), after / before)
    return F.coalesce(5 * clip(F.log(ratio), -5, 5) * phi, F.lit(0.0))


def fires(v: Column) -> Column:
    return F.when(F.abs(v) > 1e-2, 1).otherwise(0)


def margin(received: Column, corrected: Column) -> Column:
    """How far a value was moved; the whole of the corrected one if none was received."""
    return F.coalesce(F.abs(received - corrected), F.abs(corrected))
