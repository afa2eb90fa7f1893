"""Column helpers. Every helper is a built-in expression, so plans stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIE_SLACK = 5.0e-10


def rnd(x: Column | str, digits: int) -> Column:
    """ROUND half away from zero, the same whatever order a sum was taken in.

    A value up to 5e-10 below a tie counts as the tie, so 1.2512499999999998 and 1.25125 both
    give 1.2513. All double arithmetic: no decimals, no branches, no overflow.
    """
    x = F.col(x) if isinstance(x, str) else x
    unit = F.lit(float(10**digits))
    size = F.abs(x) + F.lit(_TIE_SLACK) if digits < 9 else F.abs(x)
    # adding 0.0 turns a negative zero into zero
    return F.rint(size * unit) / unit * F.signum(x) + F.lit(0.0)


def settle(x: Column | str, digits: int | None) -> Column:
    """Round to ``digits``, or leave the value alone when ``digits`` is None."""
    x = F.col(x) if isinstance(x, str) else x
    return x if digits is None else rnd(x, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def share(p: Column, n: Column) -> Column:
    """100 - 100 / (1 + p / n): 100 when only n is zero, NULL when both are."""
    return F.try_divide(F.lit(100.0) * p, p + n)


def zero_if_undefined(x: Column) -> Column:
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def code(*branches: tuple[Column, int]) -> Column:
    """First true branch wins, 0 when none is true (or all are NULL)."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(0)


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("lastPrice")) / F.lit(3.0)
