"""Margin removal over arrays of prices, as column expressions.

Methods with a root use bisection inside a higher-order function, so a market is solved where
it is, without Python. Each result is normalised to sum 1; a method that has no valid answer
falls back to multiplicative, and fell_back says so.
"""

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


#: Newton's steps of power().
NEWTON = 20


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    return let(total(a), lambda t: F.transform(a, lambda x: x / t))


def inverse(odds: Column) -> Column:
    return F.transform(odds, lambda o: 1 / o)


def overround_ok(odds: Column, low: float, high: float) -> Column:
    """Whether the market's overround is within bounds."""
    return (total(inverse(odds)) - 1).between(low, high)


def bisected(f: Callable[[Column], Column], lo: float | Column, hi: float | Column) -> Column:
    """The root of a decreasing f between lo and hi."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        halved = lambda mid, up: F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))
        return let((s["lo"] + s["hi"]) / 2, lambda mid: let(f(mid) > 0, lambda up: halved(mid, up)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def multiplicative(odds: Column) -> Column:
    return normalised(inverse(odds))


def additive(odds: Column) -> Column:
    return let(inverse(odds), lambda q: let((total(q) - 1) / F.size(q), lambda share: F.transform(q, lambda x: x - share)))


def power(odds: Column) -> Column:
    """q^k with the k that makes the sum 1. The sum falls and is convex in k, so Newton's steps from 1 come to the root from the left, at most after one step beyond it."""

    def step(q: Column) -> Callable[[Column, Column], Column]:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("slope"))
        sums = lambda k: F.aggregate(q, zero, lambda s, x: let(F.pow(x, k), lambda p: F.struct((s["sum"] + p).alias("sum"), (s["slope"] + p * F.log(x)).alias("slope"))))
        return lambda k, _: let(sums(k), lambda s: F.greatest(k - (s["sum"] - 1) / s["slope"], F.lit(0.001)))

    root = lambda q: F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(1.0), step(q))
    return let(inverse(odds), lambda q: let(root(q), lambda k: F.transform(q, lambda x: F.pow(x, k))))


def logarithmic(odds: Column) -> Column:
    """A common shift of the logits that makes the sum 1."""
    clipped = F.transform(inverse(odds), lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12)))
    shifted = lambda x, c: 1 / (1 + F.exp(c - F.log(x / (1 - x))))
    root = lambda q: bisected(lambda c: F.aggregate(q, F.lit(0.0), lambda s, x: s + shifted(x, c)) - 1, -20, 20)
    return let(clipped, lambda q: let(root(q), lambda c: F.transform(q, lambda x: shifted(x, c))))


def shin_share(booksum: Column, z: Column) -> Callable[[Column], Column]:
    return lambda x: (F.sqrt(z * z + 4 * (1 - z) * x * x / booksum) - z) / (2 * (1 - z))


def shin(odds: Column) -> Column:
    """The insider-trading model: the share z that makes the sum 1, from 0 to 0.999."""
    root = lambda q, b: bisected(lambda z: F.aggregate(q, F.lit(0.0), lambda s, x: s + shin_share(b, z)(x)) - 1, 0.0, 0.999)
    return let(inverse(odds), lambda q: let(total(q), lambda b: let(root(q, b), lambda z: F.transform(q, lambda x: shin_share(b, z)(x)))))


def probit_one(q: np.ndarray) -> list[float]:
    """Phi(Phi^-1(q) - c) with the c that makes the sum 1."""
    normal = NormalDist()
    z = [normal.inv_cdf(min(max(x, 1e-12), 1 - 1e-12)) for x in q]
    lo, hi = -20.0, 20.0
    for _ in range(STEPS):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(normal.cdf(x - c) for x in z) > 1 else (lo, c)
    p = [normal.cdf(x - (lo + hi) / 2) for x in z]
    return [x / sum(p) for x in p]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def probit_solved(q: pd.Series) -> pd.Series:
    return q.map(lambda x: None if x is None else probit_one(x))


def probit(odds: Column) -> Column:
    """A common shift of the normal quantiles; no built-in has them, so this one runs in Arrow batches."""
    return probit_solved(inverse(odds))


METHODS = {
    "multiplicative": multiplicative, "additive": additive, "differential": additive, "power": power, "logarithmic": logarithmic, "odds_ratio": logarithmic, "probit": probit, "shin": shin,
}


def devig(odds: Column, method: str = "power") -> Column:
    """fair (array) and fell_back of a market's prices; null with a price at or under 1 or fewer than two."""

    def judged(raw: Column) -> Column:
        bad = F.exists(raw, lambda p: (p <= 0) | (p >= 1) | F.isnan(p))
        if method == "shin":
            bad = bad | (total(inverse(odds)) < 1)
        return F.struct(F.when(bad, multiplicative(odds)).otherwise(normalised(raw)).alias("fair"), bad.alias("fell_back"))

    usable = (F.size(odds) >= 2) & F.forall(odds, lambda o: o > 1)
    if method == "probit":  # a Python column can't stand in a higher-order function
        p = probit(F.when(usable, odds))
        bad = (F.array_min(p) <= 0) | (F.array_max(p) >= 1)
        return F.when(usable, F.struct(F.when(bad, multiplicative(odds)).otherwise(p).alias("fair"), bad.alias("fell_back")))
    return F.when(usable, let(METHODS[method](odds), judged))
