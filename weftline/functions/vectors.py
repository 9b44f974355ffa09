"""Vector algebra as column expressions over arrays of numbers: all of it runs in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def scaled_cosine(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; 0 where a norm is at most 1e-6 or the result isn't within 0 and 1."""
    c = (dot(a, b) / (norm(a) * norm(b)) + 1) / 2
    return F.when((norm(a) > 1e-6) & (norm(b) > 1e-6) & ~F.isnan(c) & c.between(0, 1), c).otherwise(0.0)


def similarity(a: Column, b: Column, rho: float = 1.0, inner: bool = False) -> Column:
    """The trainers' measure: (rho * cosine + 1) / 2, 0 where a norm is 0; or the sigmoid of rho * dot, clipped at 6."""
    if inner:
        return sigmoid(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), rho * dot(a, b))))
    return F.when(norm(a) * norm(b) > 0, (rho * dot(a, b) / (norm(a) * norm(b)) + 1) / 2).otherwise(0.0)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def times(v: Column, k) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def unit(v: Column) -> Column:
    """v over its norm; a vector of norm 0 stays. The norm is in an array, as a lambda would compute it for each element."""
    n = norm(v)
    return F.when(n > 0, F.zip_with(doubles(v), F.array_repeat(n, F.size(v)), lambda x, y: x / y)).otherwise(doubles(v))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def table_sigmoid(x: Column, entries: int = 1000, limit: float = 6.0) -> Column:
    """The sigmoid as a table of `entries` steps between -limit and limit gives it."""
    step = F.floor((x + limit) * (entries / limit / 2))
    return sigmoid((step / F.lit(float(entries)) * 2 - 1) * limit)


def gradient_scale(x: Column, label: Column, limit: float = 6.0) -> Column:
    return F.when(x > limit, label - 1).when(x < -limit, label * 1.0).otherwise(label - sigmoid(x))


def clipped(x: Column, limit: float = 0.1) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def near(a: Column, b: Column, within: float = 1e-6) -> Column:
    return F.abs(a - b) < within


def keep_rate(cn: Column, total: Column, sample: float) -> Column:
    """The chance that a word survives subsampling (above 1: always)."""
    return (F.sqrt(cn / (sample * total)) + 1) * (sample * total) / cn


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone, not on the order of rows."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)


def initial(dim: int, *keys: Column | str) -> Column:
    """dim uniform numbers within half a 1/dim around 0, from the keys."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (uniform(*keys, i) - 0.5) / dim)


def decayed(alpha: float, done: float, total: float, floor: float = 1e-4) -> float:
    """The learning rate after `done` of `total` steps."""
    return max(alpha * (1 - done / (total + 1)), alpha * floor)


def smoothed(p: Column, gamma: float = 0.1) -> Column:
    return F.pow(p, F.lit(gamma))


def rounded(x: Column, digits: int) -> Column:
    """round() that keeps the sign of what becomes 0, as floating-point rounding does (Spark's own goes over decimals)."""
    return F.round(F.abs(x), digits) * F.signum(x)


def log2(x: Column) -> Column:
    return F.ln(x) / math.log(2)
