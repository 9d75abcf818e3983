"""Two-sided Student t tail as a vectorized UDF over aggregated rows.

Spark has no t distribution. The tail is the regularized incomplete beta function
I_x(df/2, 1/2) at x = df / (df + t^2), evaluated as a continued fraction.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's code with the task, so workers need no import path to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 500


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            total = total * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            break
    return total


def two_sided_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) with `df` degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    out[np.isinf(t) & (df > 0)] = 0.0
    ok = np.isfinite(t) & (df > 0)
    if not ok.any():
        return out
    tt, a, b = t[ok] ** 2, df[ok] / 2.0, np.full(ok.sum(), 0.5)
    x, y = df[ok] / (df[ok] + tt), tt / (df[ok] + tt)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        log_front = (
            log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log(y)
        )
    front = np.exp(log_front)
    direct = x < (a + 1.0) / (a + b + 2.0)
    low = front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a
    high = 1.0 - front * _beta_fraction(b, a, np.where(direct, 0.0, y)) / b
    out[ok] = np.clip(np.where(direct, low, high), 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def _tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(two_sided_tail(t.to_numpy(float), df.to_numpy(float)))
    return p.astype(object).where(p.notna(), None)


def two_sided_p(t: Column, df: Column) -> Column:
    """NULL where `t` or `df` is NULL or there is no degree of freedom."""
    return _tail_udf(t.cast("double"), df.cast("double"))
