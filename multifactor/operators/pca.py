"""Principal components: one Gram job, a small eigenproblem, coordinates as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions.columns import col
from multifactor.functions.linalg import eigen_symmetric
from multifactor.operators.moments import gram, moments, projection


@dataclass(frozen=True)
class Pca:
    """Principal components of some columns; ``loadings`` are correlations of variables (rows) with axes."""

    names: list[str]
    n: int
    centre: np.ndarray
    sd: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    is_correlation: bool
    divisor: np.ndarray | None = None  # what the centred columns are divided by before they are projected

    @property
    def p(self) -> int:
        return len(self.names)

    @property
    def total(self) -> float:
        return float(self.values.sum())

    @property
    def share(self) -> np.ndarray:
        return self.values / self.total if self.total > 0 else np.zeros(self.p)

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.share)

    @property
    def loadings(self) -> np.ndarray:
        scale = np.where(self.sd > 0, self.sd, np.inf)
        return self.vectors * np.sqrt(self.values) / scale[:, None]

    @property
    def correlation(self) -> np.ndarray:
        scale = np.where(self.sd > 0, self.sd, np.inf)
        out = self.covariance / np.outer(scale, scale)
        np.fill_diagonal(out, 1.0)
        return out

    def axes(self, spark: SparkSession) -> DataFrame:
        """(axis, eigenvalue, error, share, cumulative): the error is eigenvalue * sqrt(2 / (n - 1))."""
        rows = [(k + 1, float(v), float(v) * float(np.sqrt(2 / max(1, self.n - 1))), float(s), float(c)) for k, (v, s, c) in enumerate(zip(self.values, self.share, self.cumulative, strict=True))]
        return spark.createDataFrame(rows, "axis int, eigenvalue double, error double, share double, cumulative double")

    def loading_table(self, spark: SparkSession) -> DataFrame:
        """(variable, axis, loading, cos2, contribution) in long form."""
        a = self.loadings
        rows = [(v, k + 1, float(a[j, k]), float(a[j, k] ** 2), 100 * float(a[j, k] ** 2 / self.values[k]) if self.values[k] > 0 else 0.0) for j, v in enumerate(self.names) for k in range(self.p)]
        return spark.createDataFrame(rows, "variable string, axis int, loading double, cos2 double, contribution double")

    def communalities(self, spark: SparkSession, k: int) -> DataFrame:
        """(variable, communality, axis, poor): over the first k axes, the dominant one, and whether under one half."""
        a = self.loadings[:, :k]
        rows = [(v, float((a[j] ** 2).sum()), int(np.argmax(np.abs(a[j]))) + 1, bool((a[j] ** 2).sum() < 0.5)) for j, v in enumerate(self.names)]
        return spark.createDataFrame(rows, "variable string, communality double, axis int, poor boolean")

    def scores(self, df: DataFrame, k: int | None = None, keep: list[str] | None = None, prefix: str = "F") -> DataFrame:
        """Coordinates F1, F2, ... of the rows; any rows with the columns can be projected. No job runs here."""
        kept = keep if keep is not None else [c for c in ("_row", "_id") if c in df.columns]
        return df.select(*[col(c) for c in kept], *self.score_columns(k, prefix))

    def score_columns(self, k: int | None = None, prefix: str = "F") -> list[Column]:
        """The expressions of the coordinates."""
        vectors = self.vectors[:, : k or self.p]
        return projection([col(n) for n in self.names], self.centre, vectors if self.divisor is None else vectors / self.divisor[:, None], prefix)


def pca(df: DataFrame, names: list[str]) -> Pca:
    """Components of the covariances (n - 1) of complete columns; z-scaled columns give those of the correlations."""
    m = moments(df, names)
    g, n = gram(df, [col(c) for c in names], m.mean)
    c = g / max(n - 1, 1)
    values, vectors = eigen_symmetric(c)
    return Pca(list(names), int(n), m.mean, np.sqrt(np.maximum(np.diag(c), 0)), c, np.maximum(values, 0.0), vectors, bool((np.abs(np.diag(c) - 1) < 1e-6).all()))


def correlation_pca(df: DataFrame, names: list[str]) -> Pca:
    """Components of the correlations of complete unscaled columns: as ``pca`` of z-scores, in two jobs in all.

    A constant column takes no part in any axis.
    """
    m = moments(df, names)
    g, n = gram(df, [col(c) for c in names], m.mean)
    c = g / max(n - 1, 1)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    safe = np.where(sd > 0, sd, 1.0)
    r = c / np.outer(safe, safe)
    values, vectors = eigen_symmetric(r)
    unit = np.where(sd > 0, 1.0, 0.0)
    return Pca(list(names), int(n), m.mean, unit, r, np.maximum(values, 0.0), vectors, bool((sd > 0).all()), safe)


def standardised(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the columns as z-scores (sample sd); a constant becomes 0."""
    m = moments(df, names)
    return df.withColumns({c: (col(c) - F.lit(float(a))) / F.lit(float(s)) if s > 0 else F.lit(0.0) for c, a, s in zip(names, m.mean, m.sd, strict=True)})
