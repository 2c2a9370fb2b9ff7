"""What axes mean: correlations, test values, group comparisons, residuals and names."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.functions import columns as C
from multifactor.functions import distributions as D
from multifactor.functions.columns import col
from multifactor.operators.inference import anova, kruskal
from multifactor.operators.rotation import Rotation
from multifactor.operators.storage import stored


#: Clusters that categories are held against: each level gets a row for each.
MOST_CLUSTERS = 1000


def describe_numeric(rows: DataFrame, variables: Sequence[str], axes: Sequence[str], most_p: float = 1.0) -> DataFrame:
    """(axis, variable, r, r2, p) by axis and falling |r|; one aggregation for all pairs."""
    pairs = [(a, v) for a in axes for v in variables]
    row = rows.agg(*[f for a, v in pairs for f in (F.coalesce(C.correlation(col(v), col(a)), F.lit(0.0)), F.count_if(col(v).isNotNull() & col(a).isNotNull()))]).first()
    out = []
    for i, (a, v) in enumerate(pairs):
        r, n = float(row[2 * i]), row[2 * i + 1]
        p = D.correlation_p(r, n)
        if p is None or p <= most_p:
            out.append((a, v, r, r * r, p))
    return rows.sparkSession.createDataFrame(sorted(out, key=lambda x: (axes.index(x[0]), -abs(x[2]))), "axis string, variable string, r double, r2 double, p double")


def test_value(mean, overall, variance, n, total):
    """(mean - overall) over its sd under sampling without replacement; 0 where that is 0. For columns."""
    s2 = variance / n * (total - n) / F.greatest(total - 1, F.lit(1))
    return F.when(s2 > 0, (mean - overall) / F.sqrt(F.greatest(s2, F.lit(1e-300)))).otherwise(0.0)


def test_values(rows: DataFrame, variable: str, measures: Sequence[str]) -> DataFrame:
    """(level, measure, n, mean, v, p): test value of each level's mean of each measure (population variance)."""
    used = rows.where(col(variable).isNotNull())
    overall = used.agg(F.count("*").alias("N"), *[f.alias(f"{k}{i}") for i, m in enumerate(measures) for k, f in (("m", F.avg(col(m))), ("s", F.var_pop(col(m))))]).first()
    groups = used.groupBy(col(variable).cast("string").alias("level")).agg(F.count("*").alias("n"), *[F.avg(col(m)).alias(f"g{i}") for i, m in enumerate(measures)])
    long = groups.select("level", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"g{i}").alias("mean"), F.lit(overall[f"m{i}"]).alias("o"), F.lit(overall[f"s{i}"]).alias("s")) for i, m in enumerate(measures)])).alias("x"))
    v = test_value(F.col("x.mean"), F.col("x.o"), F.col("x.s"), F.col("n"), F.lit(overall.N))
    return long.select("level", "x.measure", "n", "x.mean", v.alias("v")).withColumn("p", D.normal_two_sided_column("v"))


def category_test_values(rows: DataFrame, variable: str, cluster: str) -> DataFrame:
    """(level, cluster, n_in, n_cluster, n_level, share_in, share_all, v, p) of every level and cluster; clusters are few, MOST_CLUSTERS at most."""
    used = rows.where(col(variable).isNotNull() & col(cluster).isNotNull()).select(col(variable).cast("string").alias("level"), col(cluster).alias("cluster"))
    counts = used.groupBy("level", "cluster").agg(F.count("*").alias("n_in"))
    level, group = used.groupBy("level").agg(F.count("*").alias("n_level")), used.groupBy("cluster").agg(F.count("*").alias("n_cluster"))
    n, sizes = used.count(), group.limit(MOST_CLUSTERS + 1).collect()
    if len(sizes) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    each = F.array(*[F.struct(F.lit(g.cluster).alias("cluster"), F.lit(g.n_cluster).alias("n_cluster")) for g in sizes]) if sizes else F.array().cast(f"array<struct<cluster:{group.schema['cluster'].dataType.simpleString()},n_cluster:bigint>>")
    grid = level.select("*", F.explode(each).alias("g")).select("level", "n_level", "g.*").join(counts, ["level", "cluster"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    share = F.col("n_level") / n
    s2 = F.col("n_cluster") * share * (1 - share) * (n - F.col("n_cluster")) / max(1, n - 1)
    v = F.when(s2 > 0, (F.col("n_in") - F.col("n_cluster") * share) / F.sqrt(F.greatest(s2, F.lit(1e-300)))).otherwise(0.0)
    return grid.select("level", "cluster", "n_in", "n_cluster", "n_level", (100 * F.col("n_in") / F.col("n_cluster")).alias("share_in"), (100 * share).alias("share_all"), v.alias("v")).withColumn("p", D.normal_two_sided_column("v"))


def effect_label(p: float, eta2: float) -> str:
    """Size of a difference between groups."""
    return "none" if not p < 0.05 else "large" if eta2 >= 0.14 else "medium" if eta2 >= 0.06 else "small"


def group_means(rows: DataFrame, group: str, axes: Sequence[str]) -> DataFrame:
    """(level, axis, n, mean, sd, se, low, high): means with 95 % intervals, levels of two rows or more."""
    g = rows.where(col(group).isNotNull()).groupBy(col(group).cast("string").alias("level")).agg(F.count("*").alias("n"), *[f.alias(f"{k}{i}") for i, a in enumerate(axes) for k, f in (("m", F.avg(col(a))), ("s", F.stddev_samp(col(a))))]).where("n >= 2")
    long = g.select("level", "n", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd")) for i, a in enumerate(axes)])).alias("x")).select("level", "n", "x.*")
    se = F.col("sd") / F.sqrt("n")
    return long.select("level", "axis", "n", "mean", "sd", se.alias("se"), (F.col("mean") - 1.96 * se).alias("low"), (F.col("mean") + 1.96 * se).alias("high"))


def compare_groups(rows: DataFrame, group: str, axes: Sequence[str]) -> DataFrame:
    """(axis, F, p, eta2, omega2, H, p_rank, effect): ANOVA and Kruskal-Wallis of each axis over levels of two or more."""
    sizes = rows.where(col(group).isNotNull()).groupBy(col(group).alias("_g")).count().where("count >= 2").select("_g")
    used = stored(rows.select(col(group), *[col(a) for a in axes]).join(sizes, col(group) == F.col("_g"), "left_semi"))  # Spark picks the join, and every axis reads its result
    out = []
    for a in axes:
        f, h = anova(used, a, group), kruskal(used, a, group)
        if f and h:
            out.append((a, float(f["F"]), float(f["p"]), float(f["eta2"]), float(f["omega2"]), float(h["H"]), float(h["p"]), effect_label(f["p"], f["eta2"])))
    return rows.sparkSession.createDataFrame(out, "axis string, F double, p double, eta2 double, omega2 double, H double, p_rank double, effect string")


def residuals(r: np.ndarray, pattern: np.ndarray, phi: np.ndarray | None = None) -> dict[str, object]:
    """Correlations less those that the loadings reproduce: matrix, root mean square off the diagonal, pairs over 0.05."""
    phi = np.eye(pattern.shape[1]) if phi is None else phi
    left = r - pattern @ phi @ pattern.T
    off = left[np.triu_indices(len(r), 1)]
    return {"matrix": left, "rmsr": float(np.sqrt((off**2).mean())) if off.size else 0.0, "over": int((np.abs(off) > 0.05).sum()), "share_over": float((np.abs(off) > 0.05).mean()) if off.size else 0.0}


def residual_table(spark: SparkSession, r: np.ndarray, rotation: Rotation, names: Sequence[str]) -> DataFrame:
    """(a, b, residual) of each pair."""
    m = residuals(r, rotation.pattern, rotation.phi)["matrix"]
    return spark.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, residual double")


def suggest_name(names: Sequence[str], loadings: Sequence[float], threshold: float = 0.5, each: int = 3) -> str:
    """A name from the dominant elements: positive ones, against negative ones."""
    strong = sorted((x for x in zip(names, loadings, strict=True) if abs(x[1]) >= threshold), key=lambda x: -abs(x[1]))
    up, down = [n for n, v in strong if v > 0][:each], [n for n, v in strong if v < 0][:each]
    return " vs ".join(" + ".join(side) for side in (up, down) if side) or "undefined"


def element_table(points: DataFrame, threshold: float | None = None) -> DataFrame:
    """Elements (name, axis, coord, cos2, contribution) by axis and falling contribution; with a bar for the expected one."""
    bar = F.lit(threshold) if threshold is not None else 100 / F.count("*").over(W.partitionBy("axis"))
    return points.withColumn("expected", bar).withColumn("dominant", F.col("contribution") >= F.col("expected")).orderBy("axis", F.desc("contribution"))


def narrative(spark_rows: Sequence[tuple[str, str, float]], levels: Sequence[tuple[str, float]], share: float) -> str:
    """A sentence on an axis: its share, its strong variables, and its six categories of largest |v| (1.96 or more)."""
    strong = ", ".join(f"{v} ({r:+.2f})" for _, v, r in spark_rows if abs(r) >= 0.5) or "no variable above 0.5"
    top = sorted((x for x in levels if abs(x[1]) >= 1.96), key=lambda x: -abs(x[1]))[:6]
    text = ", ".join(f"{n} (v = {v:+.1f})" for n, v in top)
    return f"The axis holds {100 * share:.1f} % of the variance; it goes with {strong}." + (f" Categories: {text}." if text else "")


def standard_error(lam: float, n: int) -> float:
    """Asymptotic standard error of an eigenvalue."""
    return lam * math.sqrt(2 / max(1, n - 1))
