"""Tail probabilities for a handful of test statistics.

Shipped to executors by value where a result table needs a p-value column.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) for a chi-square variable."""
    if x <= 0:
        return 1.0
    a, half = df / 2.0, x / 2.0
    scale = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= half / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = half + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d or tiny)
        c = 1 + even / c or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d or tiny)
        c = 1 + odd / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(x: float, df1: float, df2: float) -> float:
    """P(X > x) for an F variable."""
    if x <= 0:
        return 1.0
    return beta_cdf(df2 / (df2 + df1 * x), df2 / 2.0, df1 / 2.0)


def chi2_tails(x: pd.Series, df: pd.Series) -> pd.Series:
    found = [chi2_tail(a, b) if pd.notna(a) else None for a, b in zip(x, df, strict=True)]
    return pd.Series(found, dtype="float64")


def f_tails(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    rows = zip(x, df1, df2, strict=True)
    found = [f_tail(a, b, c) if pd.notna(a) else None for a, b, c in rows]
    return pd.Series(found, dtype="float64")
