"""Null-safe column helpers. Missing numbers are NULL, never NaN or infinity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def as_col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Name, b: Name) -> Column:
    """a / b, NULL where b is zero or either side is NULL."""
    return F.try_divide(as_col(a), as_col(b))


def null_if_zero(c: Name) -> Column:
    return F.nullif(as_col(c), F.lit(0.0))


def finite(c: Name) -> Column:
    """NaN and infinities become NULL."""
    x = as_col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clip(c: Name, low: float, high: float) -> Column:
    x = as_col(c)
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def micros(ts: Name) -> Column:
    """Microseconds since the epoch of a UTC wall-clock column."""
    return F.unix_micros(as_col(ts).cast("timestamp"))
