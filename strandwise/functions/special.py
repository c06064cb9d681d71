"""Functions that Spark lacks, in Arrow batches: gamma and beta functions, Fisher's exact test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def gamma_lower(s: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0 or s <= 0:
        return 0.0
    if x < s + 1:  # a power series
        term = total = 1 / s
        k = s
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * math.exp(s * math.log(x) - x - math.lgamma(s))
    return 1 - gamma_upper(s, x)


def gamma_upper(s: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < s + 1:
        return 1 - gamma_lower(s, x)
    b, d = x + 1 - s, 1 / (x + 1 - s)  # a continued fraction from its head
    c, h = 1e300, d
    for i in range(1, 10_000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b)
        c = b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(s * math.log(x) - x - math.lgamma(s))


def beta_regularised(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, h = 1.0, 1 - (a + b) * x / (a + 1) or 1e-300, 0.0
    d = 1 / d
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def fisher(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float]:
    """P-values of a table: at most n11, at least n11, and two-sided (tables that are no likelier)."""
    row, column, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    choose = lambda a, k: math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1)
    ks = np.arange(max(0, row + column - n), min(row, column) + 1)
    p = np.exp([choose(row, k) + choose(n - row, column - k) - choose(n, column) for k in ks])
    own = p[ks == n11][0]
    return min(1.0, float(p[ks <= n11].sum())), min(1.0, float(p[ks >= n11].sum())), min(1.0, float(p[p <= own * (1 + 1e-7)].sum()))


def _each(f):
    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*x) if not any(pd.isna(v) for v in x) else None for x in zip(*columns)], dtype="float64")

    return F.pandas_udf(batch, "double")


def lgamma(x):
    return _each(math.lgamma)(x)


def erfc(x):
    return _each(math.erfc)(x)


def incomplete_gamma(s, x):
    return _each(gamma_lower)(s, x)


def incomplete_beta(a, b, x):
    return _each(beta_regularised)(a, b, x)


def fisher_exact(n11, n12, n21, n22):
    """The two-sided p-value."""
    return _each(lambda *t: fisher(*map(int, t))[2])(n11, n12, n21, n22)
