"""Row-wise building blocks.

The engine knows one kind of missing value: SQL NULL.  NaN is turned into NULL
as soon as it can appear, infinities stay values.  Every helper mentions its
operands as few times as possible so that nested formulas stay small plans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def drop_nan(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    """NaN and both infinities become NULL; what window aggregates read."""
    return F.when(x - x == 0.0, x)


def add(a, b) -> Column:
    return drop_nan(as_column(a) + as_column(b))


def subtract(a, b) -> Column:
    return drop_nan(as_column(a) - as_column(b))


def multiply(a, b) -> Column:
    return drop_nan(as_column(a) * as_column(b))


def divide(a, b) -> Column:
    """IEEE division without raising: x/0 is a signed infinity, 0/0 is NULL."""
    a, b = as_column(a), as_column(b)
    by_zero = F.when(a > 0, INF).when(a < 0, -INF)
    return drop_nan(F.when(b == 0, by_zero).otherwise(a / b))


def power(a, b) -> Column:
    return drop_nan(F.pow(as_column(a), as_column(b)))


def negate(a) -> Column:
    return -as_column(a)


def sign(x) -> Column:
    return F.signum(as_column(x))


def absolute(x) -> Column:
    return F.abs(as_column(x))


def logarithm(x) -> Column:
    """Natural log, NULL for x <= 0."""
    x = as_column(x)
    return F.when(x > 0, F.ln(x))


def signed_power(x, a) -> Column:
    x = as_column(x)
    return drop_nan(F.signum(x) * F.pow(F.abs(x), as_column(a)))


def smaller(a, b) -> Column:
    """Minimum of two series, NULL when either is NULL (``least`` skips NULLs)."""
    a, b = as_column(a), as_column(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a, b) -> Column:
    a, b = as_column(a), as_column(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def less(a, b) -> Column:
    return (as_column(a) < as_column(b)).cast("double")


def less_equal(a, b) -> Column:
    return (as_column(a) <= as_column(b)).cast("double")


def greater_equal(a, b) -> Column:
    return (as_column(a) >= as_column(b)).cast("double")


def choose(condition, a, b) -> Column:
    """``a`` where the 1.0/0.0 condition holds, else ``b``; NULL condition gives NULL."""
    c = as_column(condition)
    return F.when(c != 0, as_column(a)).when(c == 0, as_column(b))
