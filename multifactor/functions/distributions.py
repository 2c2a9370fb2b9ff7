"""Probability tails as plain functions of numbers, and as vectorised column functions.

The column functions are for columns of already aggregated statistics; nothing row-sized needs them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0 or a <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))
    return 1 - gamma_q(a, x)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma, without cancellation in the tail."""
    if x <= 0 or a <= 0:
        return 1.0
    if x < a + 1:
        return 1 - gamma_p(a, x)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_cdf(x: float, df: float) -> float:
    """Chi-square distribution function."""
    return gamma_p(df / 2, x / 2)


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution; 0 at infinity."""
    return 0.0 if math.isinf(x) else gamma_q(df / 2, x / 2)


def chi2_quantile(p: float, df: float) -> float:
    """Value with distribution function ``p``: Newton's steps from the Wilson-Hilferty cube, in logarithms so that none leaves the axis."""
    if not 0 < p < 1:
        return 0.0 if p <= 0 else math.inf
    z = NormalDist().inv_cdf(p)
    cube = 1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))
    # low quantiles of few degrees lie where the series' first term rules
    x = df * cube**3 if cube > 0.1 else 2 * math.exp((math.log(p) + math.lgamma(df / 2 + 1)) * 2 / df)
    for _ in range(60):
        density = math.exp((df / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(df / 2)) / 2
        gap = chi2_cdf(x, df) - p if p < 0.5 else (1 - p) - chi2_tail(x, df)
        step = max(-1.0, min(1.0, gap / (density * x)))
        x *= math.exp(-step)
        if abs(step) < 1e-15:
            break
    return x


def normal_cdf(z: float) -> float:
    """Standard normal distribution function."""
    return math.erfc(-z / math.sqrt(2)) / 2


def normal_two_sided(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2))


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction, on the side where it converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    """Two-sided Student p-value."""
    return 0.0 if math.isinf(t) else beta_i(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution; 1 at or below 0, 0 at infinity."""
    if f <= 0:
        return 1.0
    return 0.0 if math.isinf(f) else beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def correlation_p(r: float, n: float) -> float | None:
    """p-value of a Pearson correlation of ``n`` pairs; None with two pairs or fewer."""
    if n <= 2:
        return None
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def erf(x: float) -> float:
    """The error function."""
    return math.erf(x)


def log_gamma(x: float) -> float:
    """Natural logarithm of the gamma function."""
    return math.lgamma(x)


def column_function(function: Callable[..., float | None]) -> Callable[..., Column]:
    """A column function of one of the functions above; null where an argument is null."""

    def apply(*columns: Column | str) -> Column:
        @F.pandas_udf(T.DoubleType())
        def run(*series: pd.Series) -> pd.Series:
            rows = zip(*series, strict=True)
            return pd.Series([None if any(pd.isna(v) for v in row) else function(*map(float, row)) for row in rows], dtype="float64")

        return run(*columns)

    return apply


chi2_tail_column = column_function(chi2_tail)
t_two_sided_column = column_function(t_two_sided)
f_tail_column = column_function(f_tail)
normal_two_sided_column = column_function(normal_two_sided)
correlation_p_column = column_function(correlation_p)
