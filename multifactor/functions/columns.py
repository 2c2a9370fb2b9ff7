"""Aggregate and scalar expressions with the statistics' exact definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of exactly this name."""
    return F.col(quoted(name))


def _safe(x: Column) -> Column:
    """The central moments' input as double."""
    return x.cast("double")


def skewness(x: Column) -> Column:
    """sqrt(n(n-1))/(n-2) times the mean cube of (x - mean)/sd with the SAMPLE sd; 0 for a constant, null under 3."""
    n = F.count(x)
    factor = F.sqrt(n * (n - 1.0)) / F.greatest(n - 2.0, F.lit(1.0)) * F.pow((n - 1.0) / F.greatest(n, F.lit(1)), F.lit(1.5))
    return F.when(n < 3, F.lit(None).cast("double")).when(F.stddev_samp(_safe(x)) > 0, factor * F.skewness(_safe(x))).otherwise(0.0)


def skewness_g1(x: Column) -> Column:
    """The usual bias-corrected skewness G1."""
    n = F.count(x)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.stddev_samp(_safe(x)) > 0, F.sqrt(n * (n - 1.0)) / F.greatest(n - 2.0, F.lit(1.0)) * F.skewness(_safe(x))).otherwise(0.0)


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis G2; 0 for a constant, null under 4."""
    n = F.count(x)
    corrected = (n - 1.0) / (F.greatest(n - 2.0, F.lit(1.0)) * F.greatest(n - 3.0, F.lit(1.0))) * ((n + 1.0) * F.kurtosis(_safe(x)) + 6.0)
    return F.when(n < 4, F.lit(None).cast("double")).when(F.stddev_samp(_safe(x)) > 0, corrected).otherwise(0.0)


def skewness_error(n: Column) -> Column:
    """Standard error of the skewness of n values."""
    n = n.cast("double")
    return F.when(n > 2, F.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))))


def kurtosis_error(n: Column) -> Column:
    """Standard error of the kurtosis of n values."""
    n = n.cast("double")
    return F.when(n > 3, 2 * skewness_error(n) * F.sqrt((n * n - 1) / ((n - 3) * (n + 5))))


def quantile(x: Column, p: float) -> Column:
    """Linear-interpolation quantile (type 7)."""
    return F.percentile(_safe(x), F.lit(p))


def iqr(x: Column) -> Column:
    """Third less first quartile."""
    return quantile(x, 0.75) - quantile(x, 0.25)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, _safe(x)), F.when(both, _safe(y))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


TRANSFORMS = ("none", "log", "log10", "sqrt", "inverse")


def transformed(x: Column, how: str, least: float) -> Column:
    """A transform of x; ``least`` is the column's minimum, which decides the shift."""
    shift = {"none": 0.0, "sqrt": -least if least < 0 else 0.0}.get(how, 1.0 - least if least <= 0 else 0.0)
    y = _safe(x) + F.lit(float(shift))
    return {"none": lambda: _safe(x), "log": lambda: F.log(y), "log10": lambda: F.log10(y), "sqrt": lambda: F.sqrt(y), "inverse": lambda: F.try_divide(F.lit(1.0), y)}[how]()
