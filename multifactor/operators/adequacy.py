"""Is a prepared table fit for factor analysis? Sphericity, sampling adequacy, outliers, a score and advice."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multifactor.functions import columns as C
from multifactor.functions import distributions as D
from multifactor.functions.columns import col
from multifactor.functions.linalg import determinant, eigen_symmetric, inverse, to_correlation
from multifactor.operators.moments import gram, moments
from multifactor.operators.prepare import Prepared


def bartlett(r: np.ndarray, n: int) -> dict[str, float | bool]:
    """Bartlett's test of sphericity of a correlation matrix from n rows."""
    p = len(r)
    det = determinant(r)
    df = p * (p - 1) // 2
    if det <= 0:
        return {"chi2": math.inf, "df": df, "p": 0.0, "det": det, "singular": True}
    chi2 = -((n - 1) - (2 * p + 5) / 6) * math.log(det)
    return {"chi2": chi2, "df": df, "p": D.chi2_tail(chi2, df), "det": det, "singular": False}


def kmo(r: np.ndarray) -> dict[str, object] | None:
    """Kaiser-Meyer-Olkin measure, each variable's own (msa) and partial correlations; None if singular."""
    inv = inverse(r)
    if inv is None:
        return None
    d = np.sqrt(np.diag(inv))
    partial = -inv / np.outer(d, d)
    np.fill_diagonal(partial, 1.0)
    off = ~np.eye(len(r), dtype=bool)
    r2, p2 = np.where(off, r * r, 0), np.where(off, partial * partial, 0)
    with np.errstate(invalid="ignore"):
        return {"overall": float(r2.sum() / (r2.sum() + p2.sum())), "msa": r2.sum(1) / (r2.sum(1) + p2.sum(1)), "partial": partial}


def msa_verdict(value: float) -> str:
    """Label of a sampling adequacy."""
    return next((label for least, label in ((0.8, "very good"), (0.7, "good"), (0.6, "fair"), (0.5, "poor")) if value >= least), "unacceptable")


def mahalanobis(df: DataFrame, names: list[str]) -> DataFrame | None:
    """``df`` with ``d2``: squared Mahalanobis distance to the centroid (covariance n - 1); None if singular."""
    m = moments(df, names)
    g, n = gram(df, [col(c) for c in names], m.mean)
    inv = inverse(g / max(n - 1, 1))
    if inv is None:
        return None
    centred = [col(c).cast("double") - F.lit(float(v)) for c, v in zip(names, m.mean, strict=True)]
    total: Column = F.lit(0.0)
    for i, x in enumerate(centred):
        for j in range(i, len(names)):
            total = total + F.lit(float(inv[i, j] * (1 if i == j else 2))) * x * centred[j]
    return df.withColumn("d2", total)


@dataclass(frozen=True)
class Diagnosis:
    """Figures of a prepared table's fitness; ``pairs`` (a, b, r) by falling size, ``outliers`` a frame by falling d2."""

    n: int
    p: int
    names: list[str]
    r: np.ndarray
    bartlett: dict
    kmo: dict | None
    eigenvalues: np.ndarray
    pairs: list[tuple[str, str, float]]
    outliers: DataFrame | None
    outlier_count: int | None
    scale_ratio: float
    skewed: list[str]
    missing_share: float
    scaling: str
    score: int

    @property
    def redundant(self):
        return [x for x in self.pairs if abs(x[2]) >= 0.9]

    @property
    def strong(self):
        return [x for x in self.pairs if abs(x[2]) >= 0.3]

    @property
    def mean_abs_r(self) -> float:
        return float(np.mean([abs(x[2]) for x in self.pairs])) if self.pairs else 0.0

    @property
    def above_one(self) -> int:
        return int((self.eigenvalues > 1).sum())

    @property
    def two_axes(self) -> float:
        return float(self.eigenvalues[:2].sum() / self.p)

    @property
    def grade(self) -> str:
        return grade(self.score)


def grade(score: float) -> str:
    """A to D."""
    return "A" if score >= 82 else "B" if score >= 66 else "C" if score >= 48 else "D"


def suitability(n: int, p: int, overall: float | None, bart: dict, missing_share: float) -> int:
    """Points out of 100 for the measures of adequacy, size, missing cells and conditioning."""
    k, ratio, det = overall or 0.0, n / p, bart["det"]
    step = lambda x, pairs, rest: next((v for least, v in pairs if x >= least), rest)
    score = step(k, ((0.8, 30), (0.7, 24), (0.6, 17), (0.5, 9)), 0) + (20 if bart["p"] < 0.05 else 0)
    score += step(ratio, ((10, 20), (5, 14), (3, 8)), 2) + step(n, ((100, 10), (50, 7), (30, 4)), 1)
    score += 10 if missing_share < 0.05 else 6 if missing_share < 0.15 else 2
    return score + (10 if det > 1e-5 and not bart["singular"] else 5 if det > 1e-9 else 0)


def correlation_of(df: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Pearson correlations of complete columns from one Gram job; pairs with a constant are 0."""
    m = moments(df, names)
    g, n = gram(df, [col(c) for c in names], m.mean)
    return to_correlation(g), int(n)


def diagnose(prepared: Prepared, scaling: str = "z") -> Diagnosis:
    """All figures: correlations on the scaled columns; outliers, scales and skewness on the unscaled ones."""
    df, names = prepared.frame, prepared.active
    raw = [prepared.raw(n) for n in names]
    r, n = correlation_of(df, names)
    p = len(names)
    bart, measure = bartlett(r, n), kmo(r)
    pairs = sorted(((a, b, float(r[i, i + 1 + j])) for i, a in enumerate(names) for j, b in enumerate(names[i + 1 :])), key=lambda x: -abs(x[2]))
    outliers, count = None, None
    if n > p + 2 and (far := mahalanobis(df.select("_row", "_id", *[col(c) for c in raw]), raw)) is not None:
        outliers = far.where(F.col("d2") > D.chi2_quantile(0.999, p)).select("_row", "_id", "d2").orderBy(F.desc("d2"))
        count = outliers.count()
    row = df.agg(*[F.stddev_samp(col(c)) for c in raw], *[C.skewness(col(c)) for c in raw]).first()
    sds = [v or 0.0 for v in row[:p]]
    ratio = max(sds) / (min((s for s in sds if s > 0), default=0) or 1)
    skewed = [a for a, s in zip(names, row[p:], strict=True) if abs(s or 0) > 1]
    score = suitability(n, p, measure and measure["overall"], bart, prepared.missing_share)
    return Diagnosis(n, p, names, r, bart, measure, eigen_symmetric(r)[0], pairs, outliers, count, ratio, skewed, prepared.missing_share, scaling, score)


def advice(d: Diagnosis, listwise_lost: float = 0.0) -> list[tuple[str, str, str]]:
    """Ten checks as (check, level, figures); levels are ok, warn, bad and info."""
    ratio = d.n / d.p
    overall = d.kmo["overall"] if d.kmo else 0.0
    low = [n for n, v in zip(d.names, d.kmo["msa"], strict=True) if v < 0.5] if d.kmo else []
    adequacy = "ok" if overall >= 0.8 else "warn" if overall >= 0.6 else "bad"
    if low and adequacy == "ok":
        adequacy = "warn"
    unscaled = d.scaling in ("none", "center")
    missing = "ok" if d.missing_share <= 0.05 else "warn" if d.missing_share <= 0.15 else "bad"
    if listwise_lost > 0.1 and missing == "ok":
        missing = "warn"
    return [
        ("sample size", "ok" if ratio >= 10 and d.n >= 100 else "warn" if ratio >= 5 else "bad", f"n = {d.n}, p = {d.p}, n:p = {ratio:.1f}"),
        ("Bartlett", "bad" if d.bartlett["singular"] else "ok" if d.bartlett["p"] < 0.05 else "bad", f"chi2 = {d.bartlett['chi2']:.2f}, p = {d.bartlett['p']:.4g}"),
        ("KMO", adequacy, f"KMO = {overall:.3f}; msa under 0.5: {', '.join(low) or 'none'}"),
        ("correlation structure", "bad" if d.mean_abs_r < 0.3 and not d.strong else "ok", f"mean |r| = {d.mean_abs_r:.3f}, strong pairs: {len(d.strong)}"),
        ("multicollinearity", "warn" if d.redundant else "ok", f"pairs with |r| of 0.90 or more: {len(d.redundant)}"),
        ("scales", ("bad" if d.scale_ratio > 4 else "warn") if unscaled else "ok" if d.scaling == "z" else "info", f"largest over smallest sd: {d.scale_ratio:.2f}"),
        ("missing data", missing, f"missing: {100 * d.missing_share:.1f} %"),
        ("outliers", "info" if d.outlier_count is None else "warn" if d.outlier_count else "ok", f"beyond the 0.999 quantile: {d.outlier_count}"),
        ("skewness", "warn" if d.skewed else "ok", f"|skewness| over 1: {', '.join(d.skewed) or 'none'}"),
        ("dimensionality", "info", f"eigenvalues over 1: {d.above_one}; two axes hold {100 * d.two_axes:.1f} %{' and suffice' if d.two_axes > 0.6 else ''}"),
    ]
