"""Result tables in the layout in which they are handed on: a line for each variable, a column for each axis or variable.

``writers.write_table`` writes any of them as CSV.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.functions.columns import col
from multifactor.operators.describe import residuals
from multifactor.operators.factor_maps import supplementary_levels, supplementary_numeric
from multifactor.operators.rotation import Rotation


def matrix_table(spark: SparkSession, matrix: np.ndarray, lines: Sequence[str], columns: Sequence[str], first: str = "variable", digits: int | None = None) -> DataFrame:
    """A matrix with its lines' names in the column ``first``."""
    held = np.asarray(matrix, float) if digits is None else np.round(np.asarray(matrix, float), digits) + 0.0
    fields = ", ".join(f"`{c.replace('`', '``')}` double" for c in columns)
    return spark.createDataFrame([(name, *map(float, line)) for name, line in zip(lines, held, strict=True)], f"{first} string, {fields}")


def axis_names(k: int) -> list[str]:
    """F1, F2, ..."""
    return [f"F{i + 1}" for i in range(k)]


def structure_table(spark: SparkSession, rotation: Rotation, names: Sequence[str]) -> DataFrame:
    """(variable, F1, F2, ...): correlations of variables and rotated axes."""
    return matrix_table(spark, rotation.structure, names, axis_names(rotation.structure.shape[1]))


def residual_matrix(spark: SparkSession, r: np.ndarray, rotation: Rotation, names: Sequence[str]) -> DataFrame:
    """(variable, one column for each variable): correlations less those that the axes reproduce."""
    return matrix_table(spark, residuals(r, rotation.pattern, rotation.phi)["matrix"], names, names)


def correlation_table(spark: SparkSession, r: np.ndarray, names: Sequence[str]) -> DataFrame:
    """(variable, one column for each variable): correlations with six decimals."""
    return matrix_table(spark, r, names, names, digits=6)


def supplementary_table(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """(kind, name, level, n, one column for each axis): numbers' correlations with the axes and levels' centroids."""
    spark, k = rows.sparkSession, list(axes)
    held: dict[str, dict] = {}
    for r in supplementary_numeric(rows, list(numeric), k).collect():
        held.setdefault(r.variable, {"n": r.n})[r.axis] = r.coord
    fields = ", ".join(f"`{a.replace('`', '``')}` double" for a in k)
    out = spark.createDataFrame([("number", v, None, held[v]["n"], *[held[v][a] for a in k]) for v in numeric], f"kind string, name string, level string, n long, {fields}")
    for c in categorical:
        levels = supplementary_levels(rows, c, k)
        out = out.unionByName(levels.select(F.lit("category").alias("kind"), F.lit(c).alias("name"), col("level").cast("string").alias("level"), "n", *[col(a) for a in k]))
    return out


def variable_summary(profiled: DataFrame, roles: Mapping[str, str] | None = None, msa: Mapping[str, float] | None = None) -> DataFrame:
    """(variable, role, n, missing, distinct, mean, sd, min, max, median, cv, skew, kurt, msa) of every column, in order.

    ``profiled`` comes from ``profile``; ``roles`` replace its suggestions; figures of texts are null.
    """
    spark = profiled.sparkSession
    given = lambda values, kind: spark.createDataFrame(list((values or {}).items()), f"_name string, _value {kind}")
    chosen, adequacy = given(roles, "string").select(F.col("_name").alias("_r"), F.col("_value").alias("_role")), given(msa, "double").select(F.col("_name").alias("_m"), F.col("_value").alias("_msa"))
    met = profiled.join(F.broadcast(chosen), F.col("name") == F.col("_r"), "left").join(F.broadcast(adequacy), F.col("name") == F.col("_m"), "left")  # one row for each column
    number = lambda c: F.when(F.col("kind") == "numeric", F.col(c)).alias(c)
    return met.orderBy("position").select(
        F.col("name").alias("variable"), F.coalesce("_role", "role").alias("role"), "n", "missing", "distinct",
        *[number(c) for c in ("mean", "sd", "min", "max", "median", "cv", "skew", "kurt")], F.col("_msa").alias("msa"),
    )


def loading_bars(spark: SparkSession, loadings: np.ndarray, names: Sequence[str], *, threshold: float = 0.4, by_size: bool = True) -> DataFrame:
    """(axis, place, variable, loading, over): each axis' bars, by falling size or in the variables' order."""
    a, out = np.asarray(loadings, float), []
    for k in range(a.shape[1]):
        order = sorted(range(len(names)), key=lambda j: -abs(a[j, k])) if by_size else range(len(names))
        out += [(k + 1, place + 1, names[j], float(a[j, k]), bool(abs(a[j, k]) >= threshold)) for place, j in enumerate(order)]
    return spark.createDataFrame(out, "axis int, place int, variable string, loading double, over boolean")


def group_levels(rows: DataFrame, name: str, key: str = "_row") -> DataFrame:
    """(level, place, n): the levels of a label in the order in which they first come, empty ones left out."""
    label = col(name).cast("string")
    levels = rows.where(label.isNotNull() & (label != "")).groupBy(label.alias("level")).agg(F.count("*").alias("n"), F.min(col(key)).alias("_first"))
    first = levels.groupBy().agg(F.count("*").alias("m")).first()["m"]
    if first > 100_000:
        raise ValueError(f"{first} levels are no groups of a map")
    return levels.select("level", F.row_number().over(W.orderBy("_first", "level")).alias("place"), "n")  # bounded above


def group_rows(rows: DataFrame, name: str, key: str = "_row") -> DataFrame:
    """(level, place, row key): every row's group on a map, as many rows as have a level."""
    levels = group_levels(rows, name, key)
    return rows.select(col(name).cast("string").alias("level"), col(key)).join(F.broadcast(levels.select("level", "place")), "level").select("level", "place", col(key))
