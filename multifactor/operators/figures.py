"""The data behind each figure, as frames; drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.functions import columns as C
from multifactor.functions.columns import col
from multifactor.functions.linalg import eigen_symmetric
from multifactor.operators.cluster import Tree
from multifactor.operators.describe import describe_numeric, group_means, test_values
from multifactor.operators.factor_maps import FactorMap, biplot_scale
from multifactor.operators.inference import histogram
from multifactor.operators.pca import Pca
from multifactor.operators.retention import Criterion, broken_stick


def scale_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, mean, sd, cv) by falling sd, to compare scales."""
    row = df.agg(*[f for n in names for f in (F.avg(col(n)), F.stddev_samp(col(n)))]).first()
    rows = [(n, float(row[2 * i] or 0), float(row[2 * i + 1] or 0), abs(100 * row[2 * i + 1] / row[2 * i]) if row[2 * i] else None) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[2]), "variable string, mean double, sd double, cv double")


def correlation_heatmap(spark: SparkSession, r: np.ndarray, names: Sequence[str], ordered: bool = True) -> DataFrame:
    """(a, b, row, col, r); with ``ordered`` by angle on the first two eigenvectors."""
    order = list(range(len(names)))
    if ordered and len(names) > 2:
        v = eigen_symmetric(r)[1]
        order = sorted(order, key=lambda j: math.atan2(v[j, 1], v[j, 0]))
    return spark.createDataFrame([(names[a], names[b], i, j, float(r[a, b])) for i, a in enumerate(order) for j, b in enumerate(order)], "a string, b string, row int, col int, r double")


def histogram_grid(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, bin, low, high, n, normal, skew): histograms with the normal curve's expected counts."""
    out = None
    for name in names:
        n, m, s, skew = df.agg(F.count(col(name)), F.avg(col(name)), F.stddev_samp(col(name)), C.skewness(col(name))).first()
        middle, width = (F.col("low") + F.col("high")) / 2, F.col("high") - F.col("low")
        curve = F.exp(-F.pow((middle - F.lit(float(m or 0))) / F.lit(float(s or 1)), 2) / 2) * width * F.lit(float(n / ((s or 1) * math.sqrt(2 * math.pi))))
        one = histogram(df, name).select(F.lit(name).alias("variable"), "bin", "low", "high", "n", curve.alias("normal"), F.lit(skew).cast("double").alias("skew"))
        out = one if out is None else out.unionByName(one)
    return out


def scree(spark: SparkSession, found: Pca, horn: DataFrame | None = None) -> DataFrame:
    """(axis, eigenvalue, share, cumulative, stick, mean, p95): the bars of the scree, cumulative and parallel figures."""
    stick = spark.createDataFrame([(k + 1, float(s)) for k, s in enumerate(broken_stick(found.p, found.total))], "axis int, stick double")
    out = found.axes(spark).drop("error").join(stick, "axis")
    none = F.lit(None).cast("double")
    return out.join(horn, "axis", "left") if horn is not None else out.withColumns({"mean": none, "p95": none})


def criteria_chart(spark: SparkSession, rules: Sequence[Criterion], chosen: int) -> DataFrame:
    """(criterion, k, weight, chosen)."""
    return spark.createDataFrame([(r.name, r.k, r.weight, r.k == chosen) for r in rules], "criterion string, k int, weight int, chosen boolean")


def loading_heatmap(spark: SparkSession, loadings: np.ndarray, names: Sequence[str]) -> DataFrame:
    """(variable, place, axis, loading), variables by dominant axis and falling size."""
    top = np.abs(loadings).argmax(1)
    order = sorted(range(len(names)), key=lambda j: (top[j], -abs(loadings[j, top[j]])))
    return spark.createDataFrame([(names[j], i, k + 1, float(loadings[j, k])) for i, j in enumerate(order) for k in range(loadings.shape[1])], "variable string, place int, axis int, loading double")


def loading_plane(spark: SparkSession, before: np.ndarray, after: np.ndarray, names: Sequence[str], a: int = 1, b: int = 2) -> DataFrame:
    """(variable, x, y, x_rotated, y_rotated): the points of a plane before and after rotation."""
    return spark.createDataFrame([(n, float(before[j, a - 1]), float(before[j, b - 1]), float(after[j, a - 1]), float(after[j, b - 1])) for j, n in enumerate(names)], "variable string, x double, y double, x_rotated double, y_rotated double")


def correlation_circle(spark: SparkSession, found: FactorMap, a: int = 1, b: int = 2) -> DataFrame:
    """(variable, x, y, cos2, well): arrows, and whether they pass the inner circle of radius 0.7071."""
    v = found.variables
    return spark.createDataFrame([(n, float(v[j, a - 1]), float(v[j, b - 1]), float(v[j, a - 1] ** 2 + v[j, b - 1] ** 2), bool(v[j, a - 1] ** 2 + v[j, b - 1] ** 2 >= 0.5)) for j, n in enumerate(found.names)], "variable string, x double, y double, cos2 double, well boolean")


def individuals_map(found: FactorMap, a: int = 1, b: int = 2) -> DataFrame:
    """Rows with x, y and their plane cos2."""
    x, y = F.col(f"F{a}"), F.col(f"F{b}")
    kept = [c for c in found.individuals.columns if not c.startswith("F") and c != "dist2"]
    return found.individuals.select(*[col(c) for c in kept], x.alias("x"), y.alias("y"), F.when(F.col("dist2") > 0, (x * x + y * y) / F.col("dist2")).otherwise(0.0).alias("cos2"))


def biplot(spark: SparkSession, found: FactorMap, a: int = 1, b: int = 2) -> tuple[DataFrame, DataFrame]:
    """The map of rows, and the variables' arrows fitted to it."""
    s = biplot_scale(found, a, b)
    return individuals_map(found, a, b), correlation_circle(spark, found, a, b).withColumns({"x": F.col("x") * s, "y": F.col("y") * s})


def contribution_bars(points: DataFrame, axis: int, n: int = 10) -> DataFrame:
    """The n largest contributions to an axis with the expected one (100 / elements); from (name, axis, contribution)."""
    mine = points.where(F.col("axis") == axis)
    expected = 100 / max(1, mine.count())
    return mine.orderBy(F.desc("contribution"), "name").limit(n).withColumn("expected", F.lit(expected))


def cos2_heatmap(points: DataFrame) -> DataFrame:
    """(name, axis, cos2, cumulative): quality axis by axis; from (name, axis, cos2)."""
    total = F.sum("cos2").over(W.partitionBy("name").orderBy("axis").rowsBetween(W.unboundedPreceding, W.currentRow))
    return points.select("name", "axis", "cos2", total.alias("cumulative")).orderBy("name", "axis")


def group_profile(rows: DataFrame, group: str, axes: Sequence[str]) -> DataFrame:
    """Means and intervals of each group on each axis."""
    return group_means(rows, group, axes)


def test_value_heatmap(rows: DataFrame, variables: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """(variable, level, axis, v, p) of all levels of some categorical variables."""
    out = None
    for v in variables:
        one = test_values(rows, v, axes).select(F.lit(v).alias("variable"), "level", F.col("measure").alias("axis"), "v", "p")
        out = one if out is None else out.unionByName(one)
    return out


def dimension_bars(rows: DataFrame, variables: Sequence[str], axis: str, n: int = 15, significant: bool = False) -> DataFrame:
    """The n strongest correlations with an axis, on demand only those with p under 0.05."""
    return describe_numeric(rows, variables, [axis], 0.05 if significant else 1.0).orderBy(F.desc(F.abs("r")), "variable").limit(n)


def point_map(points: DataFrame, a: int = 1, b: int = 2, n: int | None = None) -> DataFrame:
    """(side, name, x, y, cos2, contribution) of rows and columns on a plane, the n that contribute most.

    From (side, name, axis, coord, cos2, contribution) in long form.
    """
    plane = points.where(F.col("axis").isin(a, b)).groupBy("side", "name").agg(
        F.max(F.when(F.col("axis") == a, F.col("coord"))).alias("x"), F.max(F.when(F.col("axis") == b, F.col("coord"))).alias("y"), F.sum("cos2").alias("cos2"), F.sum("contribution").alias("contribution"))
    plane = plane.orderBy(F.desc("contribution"), "side", "name")
    return plane.limit(n) if n else plane


def partial_map(points: DataFrame, partial: DataFrame, n: int = 10) -> DataFrame:
    """(_row, group, x, y) of the n rows farthest out and their partial points; group 'global' is the row itself."""
    top = points.select("_row", "F1", "F2").orderBy(F.desc(F.pow("F1", F.lit(2)) + F.pow("F2", F.lit(2))), "_row").limit(n)
    mine = partial.join(F.broadcast(top.select("_row")), "_row", "left_semi").select("_row", "group", "F1", "F2")
    both = top.select("_row", F.lit("global").alias("group"), "F1", "F2").unionByName(mine)
    return both.select("_row", "group", F.col("F1").alias("x"), F.col("F2").alias("y"))


def dendrogram(spark: SparkSession, tree: Tree, q: int) -> DataFrame:
    """(node, left, right, x, height, cluster): places of all nodes in leaf order; cluster is null above the cut."""
    n, order, g = tree.n, tree.leaf_order(), tree.cut(q)
    x = np.zeros(2 * n - 1)
    x[order] = np.arange(n)
    of = [int(c) for c in g] + [None] * (n - 1)
    rows: list[tuple] = [(i, None, None, float(x[i]), 0.0, of[i]) for i in range(n)]
    for i, ((a, b), h) in enumerate(zip(tree.merges.tolist(), tree.heights, strict=True)):
        x[n + i] = (x[a] + x[b]) / 2
        of[n + i] = of[a] if of[a] == of[b] else None
        rows.append((n + i, a, b, float(x[n + i]), float(h), of[n + i]))
    return spark.createDataFrame(rows, "node int, left int, right int, x double, height double, cluster int")


def cluster_numbers(spark: SparkSession, tree: Tree, silhouettes: Sequence[tuple[int, float]]) -> DataFrame:
    """(q, loss, silhouette): inertia lost by the merge that leaves fewer than q clusters, and the mean silhouette."""
    return spark.createDataFrame([(q, float(tree.heights[-q + 1]), float(s)) for q, s in silhouettes], "q int, loss double, silhouette double")


def cluster_profile(described: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest descriptors of each cluster; from (cluster, name, v)."""
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.abs("v")), "name"))
    return described.withColumn("place", place).where(F.col("place") <= n)


def ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round marks between two values, in steps of 1, 2 or 5 times a power of ten."""
    if not high > low:
        return [low]
    raw = (high - low) / max(1, about)
    power = 10 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw * 0.999)
    first = math.ceil(low / step - 1e-9)
    return [round((first + i) * step, 12) for i in range(int(math.floor(high / step + 1e-9)) - first + 1)]


def named(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Frames registered as temporary views, so that SQL can reach them."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return dict(frames)
