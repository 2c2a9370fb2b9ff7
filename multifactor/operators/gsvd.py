"""The common core of the factor methods: a generalised SVD from one weighted Gram matrix of coded columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions.columns import col
from multifactor.functions.linalg import singular_from_gram
from multifactor.operators.moments import gram, projection

#: Levels of all variables together: the Gram matrix has so many rows.
MOST_LEVELS = 2000


@dataclass(frozen=True)
class Gsvd:
    """Axes of coded columns under row weights (sum 1), a column metric and column masses.

    ``col_coord`` are principal coordinates; for an indicator or profile coding masses differ from the metric.
    """

    names: list[str]
    coded: list[Column]
    mean: np.ndarray
    metric: np.ndarray
    mass: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    gram: np.ndarray
    total: float

    @property
    def k(self) -> int:
        return len(self.values)

    @property
    def share(self) -> np.ndarray:
        return self.values / self.total if self.total > 0 else np.zeros(self.k)

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.share)

    @property
    def col_coord(self) -> np.ndarray:
        root = np.sqrt(self.mass)
        return np.divide(self.vectors * np.sqrt(self.values), root[:, None], out=np.zeros_like(self.vectors), where=root[:, None] > 0)

    @property
    def col_cos2(self) -> np.ndarray:
        g2 = self.col_coord**2
        d2 = g2.sum(1, keepdims=True)
        return np.divide(g2, d2, out=np.zeros_like(g2), where=d2 > 0)

    @property
    def col_contribution(self) -> np.ndarray:
        return 100 * self.mass[:, None] * self.col_coord**2 / self.values

    @property
    def col_inertia(self) -> np.ndarray:
        return self.mass * (self.col_coord**2).sum(1)

    @property
    def projector(self) -> np.ndarray:
        """A centred coded row times this gives its principal coordinates."""
        return np.sqrt(self.metric)[:, None] * self.vectors

    def row_columns(self, k: int | None = None, prefix: str = "F") -> list[Column]:
        """Expressions of the rows' coordinates; supplementary rows are projected by the same ones."""
        return projection(self.coded, self.mean, self.projector[:, : k or self.k], prefix)

    def rows(self, df: DataFrame, k: int | None = None, keep: Sequence[str] = ("_row", "_id"), prefix: str = "F") -> DataFrame:
        """Coordinates of any rows with the coded columns' inputs. No job runs here."""
        return df.select(*[col(c) for c in keep if c in df.columns], *self.row_columns(k, prefix))

    def row_quality(self, df: DataFrame, weight: Column | None = None, keep: Sequence[str] = ("_row", "_id"), k: int | None = None) -> DataFrame:
        """Coordinates with cos2_k and contribution_k (weights default to 1/n, from one count)."""
        kept = [c for c in keep if c in df.columns]
        w = F.lit(1.0 / max(1, df.count())) if weight is None else weight
        coords = df.select(*[col(c) for c in kept], w.alias("w"), *self.row_columns())
        d2 = sum((F.pow(F.col(f"F{j + 1}"), 2) for j in range(self.k)), F.lit(0.0))
        return coords.select(
            *[col(c) for c in kept], *[F.col(f"F{j + 1}") for j in range(k or self.k)],
            *[F.when(d2 > 0, F.pow(F.col(f"F{j + 1}"), 2) / d2).otherwise(0.0).alias(f"cos2_{j + 1}") for j in range(k or self.k)],
            *[(100 * F.col("w") * F.pow(F.col(f"F{j + 1}"), 2) / float(self.values[j])).alias(f"contribution_{j + 1}") for j in range(k or self.k)],
        )

    def axes(self, spark: SparkSession) -> DataFrame:
        """(axis, eigenvalue, share, cumulative)."""
        rows = [(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(self.values, self.share, self.cumulative, strict=True))]
        return spark.createDataFrame(rows, "axis int, eigenvalue double, share double, cumulative double")

    def columns(self, spark: SparkSession) -> DataFrame:
        """(name, axis, coord, cos2, contribution) in long form."""
        g, q, c = self.col_coord, self.col_cos2, self.col_contribution
        rows = [(n, k + 1, float(g[j, k]), float(q[j, k]), float(c[j, k])) for j, n in enumerate(self.names) for k in range(self.k)]
        return spark.createDataFrame(rows, "name string, axis int, coord double, cos2 double, contribution double")


def from_gram(names: Sequence[str], coded: Sequence[Column], mean: np.ndarray, covariance: np.ndarray, metric: np.ndarray, mass: np.ndarray | None = None) -> Gsvd:
    """The decomposition when the weighted covariance of the coded columns is known."""
    root = np.sqrt(metric)
    values, vectors = singular_from_gram(covariance * np.outer(root, root))
    return Gsvd(list(names), list(coded), np.asarray(mean, float), np.asarray(metric, float), np.asarray(metric if mass is None else mass, float), values, vectors, covariance, float(values.sum()))


def weighted_means(df: DataFrame, coded: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """Means of coded columns under row weights."""
    if weight is None:
        return np.array([v or 0.0 for v in df.agg(*[F.avg(c.cast("double")) for c in coded]).first()])
    row = df.agg(F.sum(weight.cast("double")), *[F.sum(weight.cast("double") * c.cast("double")) for c in coded]).first()
    return np.array([(v or 0.0) / (row[0] or 1.0) for v in row[1:]])


def core(df: DataFrame, names: Sequence[str], coded: Sequence[Column], metric: np.ndarray | None = None, mass: np.ndarray | None = None, weight: Column | None = None) -> Gsvd:
    """Two jobs (means, Gram), then a small eigenproblem; axes under 1e-10 of the first are left out."""
    mean = weighted_means(df, coded, weight)
    g, total = gram(df, coded, mean, weight)
    return from_gram(names, coded, mean, g / (total or 1.0), np.ones(len(coded)) if metric is None else metric, mass)


def indicators(df: DataFrame, names: Sequence[str], order: str = "_row") -> list[tuple[str, str, float, Column]]:
    """(variable, level, share, 0/1 column) of every level, variables in order, levels by first appearance.

    Each level is a column of the Gram matrix, so more than MOST_LEVELS together are an error.
    """
    parts = None
    for i, n in enumerate(names):
        one = df.groupBy(col(n).cast("string").alias("level")).agg(F.count("*").alias("n"), F.min(col(order)).alias("first")).withColumn("v", F.lit(i))
        parts = one if parts is None else parts.unionByName(one)
    held = parts.where("level is not null").limit(MOST_LEVELS + 1).collect()
    if len(held) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels: leave out identifiers and free text")
    found = sorted((r.v, r["first"], r.level, r.n) for r in held)
    totals = {i: sum(x[3] for x in found if x[0] == i) for i in range(len(names))}
    return [(names[v], level, n / totals[v], F.when(col(names[v]).cast("string") == level, 1.0).otherwise(0.0)) for v, _, level, n in found]
