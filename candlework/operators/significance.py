"""Tail probabilities as column expressions: incomplete beta and gamma functions, the inverse beta, binomial intervals.

Tails are a fold over one row's numbers, meant for the few rows that an aggregation leaves; the inverse beta takes sixty
tails a row and computes them in numpy, a batch of rows at a time. Iterations grow with the root of the arguments, as the
continued fractions need.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_SHIFT = 8  # Stirling's series is used from here on
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)  # fixed values
_HALVINGS = 60


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""

    def series(z: Column) -> Column:
        rest = sum((F.lit(c) / F.pow(z, F.lit(2 * i + 1)) for i, c in enumerate(_STIRLING)), F.lit(0.0))
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + rest

    product = F.lit(1.0)
    for i in range(_SHIFT):
        product = product * (x + i)
    return F.when(x > 1e6, series(x)).otherwise(series(x + _SHIFT) - F.log(product))


def _kept_off_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _lentz(state: Column, numerator: Column, denominator: Column) -> Column:
    """One step of a continued fraction: (c, d, h), with d the inverse of the last denominator's tail."""
    d = 1 / _kept_off_zero(denominator + numerator * state["d"])
    c = _kept_off_zero(denominator + numerator / state["c"])
    both = F.struct(c.alias("c"), d.alias("d"))
    return let(both, lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (state["h"] * s["c"] * s["d"]).alias("h")))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    steps = F.least(F.ceil(F.sqrt(a + b) * 4) + 60, F.lit(1_000_000)).cast("int")

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(_lentz(state, even, F.lit(1.0)), lambda s: _lentz(s, odd, F.lit(1.0)))

    first = 1 / _kept_off_zero(1 - (a + b) * x / (a + 1))
    start = let(first, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised I_x(a, b) for a, b > 0: the chance that a Beta(a, b) number is at most x."""
    swapped = x > (a + 1) / (a + b + 2)
    sides = F.when(swapped, F.struct((1 - x).alias("x"), b.alias("a"), a.alias("b"))).otherwise(
        F.struct(x.alias("x"), a.alias("a"), b.alias("b"))
    )

    def smaller(s: Column) -> Column:
        logs = log_gamma(s["a"] + s["b"]) - log_gamma(s["a"]) - log_gamma(s["b"])
        power = s["a"] * F.log(s["x"]) + s["b"] * F.log1p(-s["x"])
        return F.exp(logs + power) * _fraction(s["x"], s["a"], s["b"]) / s["a"]

    part = let(sides, smaller)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(swapped, 1 - part).otherwise(part))


def _beta_function(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``incomplete_beta`` for 0 < x < 1, of many rows at once; each row's fraction ends where it stands still."""
    swapped = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swapped, 1 - x, x), np.where(swapped, b, a), np.where(swapped, a, b)
    off = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    d = 1 / off(1 - (a + b) * x / (a + 1))
    c, h, out = np.ones_like(x), d.copy(), np.empty_like(x)
    steps = np.minimum(np.ceil(np.sqrt(a + b) * 4) + 60, 1_000_000)
    at, p, q, z = np.arange(len(x)), a, b, x
    m = 0
    while len(at):
        m += 1
        before = h
        for numerator in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / off(1 + numerator * d)
            c = off(1 + numerator / c)
            h = h * c * d
        ends = (np.abs(h - before) <= 1e-16 * np.abs(h)) | (m >= steps[at])
        if ends.any():
            out[at[ends]] = h[ends]
            stay = ~ends
            at, p, q, z, c, d, h = (v[stay] for v in (at, p, q, z, c, d, h))
    logs = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    part = np.exp(logs + a * np.log(x) + b * np.log1p(-x)) * out / a
    return np.where(swapped, 1 - part, part)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """As ``log_gamma``."""
    large = x > 1e6
    z = np.where(large, x, x + _SHIFT)
    product = np.prod([np.where(large, 1.0, x + i) for i in range(_SHIFT)], axis=0)
    rest = sum(v / z ** (2 * i + 1) for i, v in enumerate(_STIRLING))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + rest - np.log(product)


def _halved(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x at which I_x(a, b) = p, by halving; NaN unless a and b are positive."""
    out = np.full(len(p), np.nan)
    known = np.flatnonzero((a > 0) & (b > 0) & ~np.isnan(p))
    p, a, b = p[known], a[known], b[known]
    low, high = np.zeros(len(p)), np.ones(len(p))
    for _ in range(_HALVINGS):
        middle = (low + high) / 2
        less = _beta_function(np.clip(middle, _TINY, 1 - 2**-53), a, b) < p
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    out[known] = (low + high) / 2
    return out


def inverse_beta(p: Column, a: Column, b: Column) -> Column:
    """The x at which I_x(a, b) = p, by halving: sixty tails a row, a whole batch of rows at a time."""

    @F.pandas_udf("double")
    def inverse(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_halved(*(v.to_numpy(float, na_value=np.nan) for v in (p, a, b))))

    return F.nanvl(inverse(*(v.cast("double") for v in (p, a, b))), F.lit(None).cast("double"))


def binomial_interval(hits: Column, rows: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """The exact interval of a share, from the tails of the binomial distribution; NULL without rows."""
    tail = F.lit((1 - confidence) / 2)
    misses = rows - hits
    lower = F.when(rows > 0, F.when(hits <= 0, 0.0).otherwise(inverse_beta(tail, hits, misses + 1)))
    upper = F.when(rows > 0, F.when(misses <= 0, 1.0).otherwise(inverse_beta(1 - tail, hits + 1, misses)))
    return lower, upper


def at_least(hits: Column, rows: Column, share: Column) -> Column:
    """The chance of at least so many hits in so many rows that each hit with the given share."""
    return F.when(rows > 0, F.when(hits <= 0, 1.0).otherwise(incomplete_beta(share, hits, rows - hits + 1)))


def chi_square_tail(x: Column, degrees: Column) -> Column:
    """The chance that a chi-square number of so many degrees of freedom is over x; NULL without degrees."""

    def tail(v: Column) -> Column:
        s, z = v["s"], v["z"]
        scale = F.exp(s * F.log(z) - z - log_gamma(s))

        def term(state: Column, i: Column) -> Column:
            return let(state["t"] * z / (s + i), lambda t: F.struct(t.alias("t"), (state["sum"] + t).alias("sum")))

        one = F.struct((1 / s).alias("t"), (1 / s).alias("sum"))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(300)), one, term, lambda a: a["sum"])
        base = 1 / _kept_off_zero(z + 1 - s)
        start = F.struct(F.lit(1 / _TINY).alias("c"), base.alias("d"), base.alias("h"))
        fraction = F.aggregate(
            F.sequence(F.lit(1), F.lit(300)), start, lambda a, i: _lentz(a, i * (s - i), z + 2 * i + 1 - s), lambda a: a["h"]
        )
        return F.when(z < s + 1, 1 - scale * series).otherwise(scale * fraction)

    value = F.struct((degrees / 2).cast("double").alias("s"), (x / 2).cast("double").alias("z"))
    return F.when(degrees > 0, F.when(x <= 0, 1.0).otherwise(let(value, tail)))
