"""Factor maps: coordinates, quality and contributions, supplementary elements, and group geometry."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.functions import columns as C
from multifactor.functions import distributions as D
from multifactor.functions.columns import col
from multifactor.operators.pca import Pca
from multifactor.operators.rotation import Rotation, thurstone


@dataclass(frozen=True)
class FactorMap:
    """Variables (p x k) and rows (columns F1.. of ``individuals``, with the squared distance ``dist2``)."""

    names: list[str]
    variables: np.ndarray
    axis_variance: np.ndarray
    total: float
    communality: np.ndarray
    individuals: DataFrame
    rotated: bool
    oblique: bool

    @property
    def k(self) -> int:
        return self.variables.shape[1]

    @property
    def share(self) -> np.ndarray:
        return self.axis_variance / self.total

    def variable_table(self, spark: SparkSession) -> DataFrame:
        """(variable, axis, coord, cos2, contribution, communality); contributions are of the axis' variance."""
        rows = []
        for j, n in enumerate(self.names):
            for k in range(self.k):
                c2 = float(self.variables[j, k] ** 2)
                rows.append((n, k + 1, float(self.variables[j, k]), c2, 100 * c2 / float(self.axis_variance[k] or 1), float(self.communality[j])))
        return spark.createDataFrame(rows, "variable string, axis int, coord double, cos2 double, contribution double, communality double")

    def individual_table(self) -> DataFrame:
        """Rows with coordinates, cos2 over all axes, and contributions in % of each axis' sum of squares."""
        axes = [f"F{k + 1}" for k in range(self.k)]
        sums = self.individuals.agg(*[F.sum(col(a) * col(a)) for a in axes]).first()
        kept = [c for c in self.individuals.columns if c not in {*axes, "dist2"}]
        d2 = F.col("dist2")
        return self.individuals.select(
            *[col(c) for c in kept], *axes,
            *[F.when(d2 > 0, col(a) * col(a) / d2).otherwise(0.0).alias(f"cos2_{i + 1}") for i, a in enumerate(axes)],
            *[(100 * col(a) * col(a) / F.lit(float(s or 1.0))).alias(f"contribution_{i + 1}") for i, (a, s) in enumerate(zip(axes, sums, strict=True))],
        )


def factor_map(df: DataFrame, found: Pca, k: int, rotation: Rotation | None = None, keep: list[str] | None = None) -> FactorMap:
    """Coordinates on k axes, rotated if a rotation of their loadings is given.

    Orthogonal: row scores times T. Oblique: Thurstone's regression scores, scaled to the axes' sums of squares.
    """
    kept = keep if keep is not None else [c for c in df.columns if c not in found.names]
    every = [F.pow(c, 2) for c in found.score_columns()]
    dist2 = every[0]
    for e in every[1:]:
        dist2 = dist2 + e
    loadings = found.loadings
    communality = (loadings**2).sum(1)
    rotated = rotation is not None and rotation.method != "none"
    if not rotated:
        rows = df.select(*[col(c) for c in kept], *found.score_columns(k), dist2.alias("dist2"))
        return FactorMap(found.names, loadings[:, :k], found.values[:k], found.total, communality, rows, False, False)
    variance = rotation.ss
    if not rotation.oblique:
        turned = found.vectors[:, :k] @ rotation.transform
        scores = Pca(found.names, found.n, found.centre, found.sd, found.covariance, found.values, turned, found.is_correlation, found.divisor).score_columns(k)
        rows = df.select(*[col(c) for c in kept], *scores, dist2.alias("dist2"))
        return FactorMap(found.names, rotation.pattern, variance, found.total, communality, rows, True, False)
    weights = thurstone(found.correlation, rotation.structure)
    sd = np.where(found.sd > 0, found.sd, 1.0)
    b = np.zeros((found.p, k)) if weights is None else weights / sd[:, None]
    spread = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", b, found.covariance, b), 0))
    b = b * np.where(spread > 0, np.sqrt(variance) / np.where(spread > 0, spread, 1.0), 0.0)
    scores = Pca(found.names, found.n, found.centre, found.sd, found.covariance, found.values, b, found.is_correlation, found.divisor).score_columns(k)
    rows = df.select(*[col(c) for c in kept], *scores, dist2.alias("dist2"))
    return FactorMap(found.names, rotation.structure, variance, found.total, communality, rows, True, True)


def supplementary_numeric(rows: DataFrame, names: list[str], axes: list[str]) -> DataFrame:
    """(variable, axis, coord, cos2, n): correlation with each axis over rows with the value; 0 under three pairs."""
    wanted = [f for v in names for f in (F.count(col(v)), *[F.coalesce(C.correlation(col(v), col(a)), F.lit(0.0)) for a in axes])]
    row = rows.agg(*wanted).first() if names else []
    out = []
    for i, v in enumerate(names):
        n, *r = row[i * (len(axes) + 1) : (i + 1) * (len(axes) + 1)]
        out += [(v, a, float(x) if n >= 3 else 0.0, float(x) ** 2 if n >= 3 else 0.0, n) for a, x in zip(axes, r, strict=True)]
    return rows.sparkSession.createDataFrame(out, "variable string, axis string, coord double, cos2 double, n long")


def supplementary_levels(rows: DataFrame, variable: str, axes: list[str]) -> DataFrame:
    """(level, n, axis means): centroid of each level's rows."""
    return rows.where(col(variable).isNotNull()).groupBy(col(variable).alias("level")).agg(F.count("*").alias("n"), *[F.avg(col(a)).alias(a) for a in axes])


def ellipses(rows: DataFrame, x: str, y: str, group: str, level: float = 0.95, of_mean: bool = False) -> DataFrame:
    """(group, n, cx, cy, a, b, angle): concentration ellipse of each group, or confidence ellipse of its mean.

    Half-axes are the roots of the covariance's eigenvalues times the chi-square quantile (2 df). Groups under 3 are left out.
    """
    q = D.chi2_quantile(level, 2)
    g = rows.groupBy(col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(col(x)).alias("cx"), F.avg(col(y)).alias("cy"), F.var_samp(col(x)).alias("xx"), F.var_samp(col(y)).alias("yy"), F.covar_samp(col(x), col(y)).alias("xy")).where("n >= 3")
    half, gap = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow(F.col("xy"), 2))
    radius = F.lit(q) / (F.col("n") if of_mean else F.lit(1.0))
    return g.select("group", "n", "cx", "cy", F.sqrt(F.greatest(half + gap, F.lit(0.0)) * radius).alias("a"), F.sqrt(F.greatest(half - gap, F.lit(0.0)) * radius).alias("b"), (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("angle"))


def ellipse_points(found: DataFrame, points: int = 73) -> DataFrame:
    """(group, point, x, y): the outline of each ellipse."""
    t = F.col("point") * F.lit(2 * math.pi / (points - 1))
    u, v = F.col("a") * F.cos(t), F.col("b") * F.sin(t)
    out = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return out.select("group", "point", (F.col("cx") + u * F.cos("angle") - v * F.sin("angle")).alias("x"), (F.col("cy") + u * F.sin("angle") + v * F.cos("angle")).alias("y"))


def hulls(rows: DataFrame, x: str, y: str, group: str, parts: int = 64) -> DataFrame:
    """(group, place, x, y): the convex hull of each group, counter-clockwise.

    Each task keeps only the corners of all its rows' hulls; these meet in ``parts`` lots first and then by group, so no
    task sees more than the corners of the tasks before it.
    """

    def corners(part: pd.DataFrame) -> pd.DataFrame:
        points = part[["x", "y"]].dropna().drop_duplicates().sort_values(["x", "y"]).to_numpy(float)

        def chain(line):
            held: list = []
            for p in line:
                while len(held) > 1 and (held[-1][0] - held[-2][0]) * (p[1] - held[-2][1]) - (held[-1][1] - held[-2][1]) * (p[0] - held[-2][0]) <= 0:
                    held.pop()
                held.append(p)
            return held

        ring = points if len(points) < 3 else np.array(chain(points)[:-1] + chain(points[::-1])[:-1])
        return pd.DataFrame({"group": part["group"].iloc[0], "place": np.arange(len(ring), dtype="int32"), "x": ring[:, 0], "y": ring[:, 1]})

    def by_task(batches):
        held: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for name, part in batch.groupby("group"):
                held[name] = corners(pd.concat([held[name], part]) if name in held else part)[["group", "x", "y"]]
        yield from held.values()

    slim = rows.where(col(group).isNotNull()).select(col(group).cast("string").alias("group"), col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    slim = slim.where("x is not null and y is not null")
    kept = slim.mapInPandas(by_task, "group string, x double, y double").withColumn("lot", F.spark_partition_id() % parts)
    met = kept.groupBy("group", "lot").applyInPandas(lambda part: corners(part)[["group", "x", "y"]], "group string, x double, y double")
    return met.groupBy("group").applyInPandas(corners, "group string, place int, x double, y double")


def quality(spark: SparkSession, found: FactorMap, a: int = 1, b: int = 2) -> DataFrame:
    """(variable, cos2, contribution, band) on a plane, best first; bands at 0.7, 0.5 and 0.3."""
    c2 = found.variables[:, a - 1] ** 2 + found.variables[:, b - 1] ** 2
    variance = found.axis_variance[a - 1] + found.axis_variance[b - 1]
    band = lambda v: "very good" if v >= 0.7 else "good" if v >= 0.5 else "fair" if v >= 0.3 else "poor"
    rows = sorted(((n, float(v), float(100 * v / variance) if variance else 0.0, band(v)) for n, v in zip(found.names, c2, strict=True)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "variable string, cos2 double, contribution double, band string")


def _plane(found: FactorMap, a: int, b: int) -> tuple[DataFrame, Column, Column]:
    rows = found.individuals
    x2, y2 = F.pow(F.col(f"F{a}"), 2), F.pow(F.col(f"F{b}"), 2)
    cos2 = F.when(F.col("dist2") > 0, (x2 + y2) / F.col("dist2")).otherwise(0.0)
    return rows, x2 + y2, cos2


def top_individuals(found: FactorMap, a: int = 1, b: int = 2, n: int = 12) -> DataFrame:
    """The n rows that contribute most to a plane, with coordinates, plane cos2 and contribution in %."""
    rows, plane, cos2 = _plane(found, a, b)
    total = rows.agg(F.sum(plane)).first()[0] or 1.0
    kept = [c for c in ("_row", "_id") if c in rows.columns]
    return rows.select(*kept, f"F{a}", f"F{b}", cos2.alias("cos2"), (100 * plane / F.lit(float(total))).alias("contribution")).orderBy(F.desc("contribution"), *kept).limit(n)


def plane_summary(found: FactorMap, a: int = 1, b: int = 2) -> DataFrame:
    """Share of the variables and of the rows with a plane cos2 of one half or more."""
    rows, _, cos2 = _plane(found, a, b)
    good = float(((found.variables[:, a - 1] ** 2 + found.variables[:, b - 1] ** 2) >= 0.5).mean())
    return rows.agg(F.lit(good).alias("variables"), (F.count_if(cos2 >= 0.5) / F.count("*")).alias("individuals"))


def biplot_scale(found: FactorMap, a: int = 1, b: int = 2) -> float:
    """Factor that fits variable arrows into the cloud of rows."""
    high = found.individuals.agg(F.max(F.greatest(F.abs(F.col(f"F{a}")), F.abs(F.col(f"F{b}"))))).first()[0] or 0.0
    arrows = float(np.abs(found.variables[:, [a - 1, b - 1]]).max()) or 1.0
    return high / arrows * 0.8


def extremes(rows: DataFrame, axes: list[str], n: int = 5) -> DataFrame:
    """(axis, end, place, _row, value): the n lowest and n highest rows of each axis, by partial top-n of each axis."""
    parts = []
    for a in axes:
        for end, order in (("low", col(a).asc()), ("high", col(a).desc())):
            top = rows.select(F.lit(a).alias("axis"), F.lit(end).alias("end"), "_row", col(a).alias("value")).orderBy(order, "_row").limit(n)
            parts.append(top.withColumn("place", F.row_number().over(W.partitionBy("axis").orderBy(F.col("value").asc() if end == "low" else F.col("value").desc(), "_row"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("axis", "end", "place", "_row", "value")
