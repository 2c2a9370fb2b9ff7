"""Profile of a table: kinds, counts, moments, suggested roles, flags and levels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.functions import columns as C
from multifactor.functions.columns import col
from multifactor.operators.quantiles import quantiles
from multifactor.sources.delimited import is_missing, to_number

NUMERIC_SHARE, NUMERIC_LEAST = 0.85, 3
FIGURES = ("mean", "sd", "min", "max", "median", "q1", "q3", "cv", "skew", "kurt", "zeros", "negatives", "all_int", "constant")
PROFILE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("role", T.StringType()),
     T.StructField("n", T.LongType()), T.StructField("missing", T.LongType()), T.StructField("missing_share", T.DoubleType()), T.StructField("distinct", T.LongType()), T.StructField("numeric_share", T.DoubleType())]
    + [T.StructField(f, T.DoubleType()) for f in FIGURES] + [T.StructField("outliers", T.LongType()), T.StructField("group_code", T.BooleanType())]
)


def _number(df: DataFrame, name: str, decimal: str) -> Column:
    kind = df.schema[name].dataType
    return col(name).cast("double") if isinstance(kind, T.NumericType) else to_number(col(name), decimal)


def _missing(df: DataFrame, name: str) -> Column:
    return is_missing(col(name)) if isinstance(df.schema[name].dataType, T.StringType) else col(name).isNull()


def profile(df: DataFrame, names: list[str] | None = None, decimal: str = "auto") -> DataFrame:
    """One row for each column, in order.

    A column is numeric if at least 85 % of its present cells are numbers, three at least; its moments are those of the
    numbers. Four jobs, whatever the number of columns: moments; distinct values; quartiles; values over three standard
    deviations from the mean.
    """
    spark, names = df.sparkSession, names or [c for c in df.columns if c != "_row"]
    wanted: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        x, gone = _number(df, name, decimal), _missing(df, name)
        wanted += [
            F.count_if(~gone).alias(f"n{i}"), F.count(x).alias(f"k{i}"),
            F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"sd{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
            C.skewness(x).alias(f"skew{i}"), C.kurtosis(x).alias(f"kurt{i}"),
            F.count_if(x == 0).alias(f"zeros{i}"), F.count_if(x < 0).alias(f"negatives{i}"), F.bool_and(x == F.floor(x)).alias(f"int{i}"),
        ]
    r = df.agg(*wanted).first().asDict()
    cells = F.array(*[F.when(~_missing(df, n), F.struct(F.lit(i).alias("i"), F.trim(col(n).cast("string")).alias("v"))) for i, n in enumerate(names)])
    different = df.select(F.explode(cells).alias("c")).where("c is not null").select("c.*").groupBy("i", "v").count().groupBy("i").agg(F.count("*").alias("u"))
    distinct_of = {x.i: x.u for x in different.collect()}
    numeric = {i: r[f"n{i}"] and r[f"k{i}"] / r[f"n{i}"] >= NUMERIC_SHARE and r[f"k{i}"] >= NUMERIC_LEAST for i in range(len(names))}
    spread = [i for i in numeric if numeric[i] and r[f"sd{i}"]]
    far = df.agg(*[F.count_if(F.abs((_number(df, names[i], decimal) - r[f"mean{i}"]) / r[f"sd{i}"]) > 3) for i in spread]).first() if spread else []
    outliers = dict(zip(spread, far, strict=True))
    quartiles = quantiles(df, {names[i]: _number(df, names[i], decimal) for i in numeric if numeric[i]}, [0.5, 0.25, 0.75])
    out = []
    for i, name in enumerate(names):
        n, rows, distinct = r[f"n{i}"], r["rows"], distinct_of.get(i, 0)
        base = {"name": name, "position": i, "n": n, "missing": rows - n, "missing_share": (rows - n) / rows if rows else 0.0, "distinct": distinct, "numeric_share": r[f"k{i}"] / n if n else 0.0, "group_code": False}
        if numeric[i]:
            mean, sd = r[f"mean{i}"], r[f"sd{i}"]
            median, q1, q3 = quartiles[name]
            constant, whole = not sd, bool(r[f"int{i}"])
            code = whole and distinct <= min(8, max(2, int(rows * 0.05 + 0.5)))
            base |= {"kind": "numeric", "role": "excluded" if constant else "supp-cat" if code else "active", "group_code": code and not constant, "mean": mean, "sd": sd, "min": r[f"min{i}"], "max": r[f"max{i}"],
                     "median": median, "q1": q1, "q3": q3, "cv": abs(sd / mean) * 100 if mean else None, "skew": r[f"skew{i}"], "kurt": r[f"kurt{i}"], "zeros": float(r[f"zeros{i}"]), "negatives": float(r[f"negatives{i}"]),
                     "all_int": float(whole), "constant": float(constant), "outliers": outliers.get(i, 0)}
        else:
            base |= {"kind": "categorical", "role": "id" if distinct == n and n > 3 else "excluded" if distinct > 30 else "supp-cat"}
        out.append(tuple(base.get(f.name) for f in PROFILE.fields))
    return spark.createDataFrame(out, PROFILE)


def levels(df: DataFrame, name: str, order: str = "_row") -> DataFrame:
    """(level, n, first) of a column's trimmed present values, by first appearance in ``order``."""
    present = df.where(~_missing(df, name)).select(F.trim(col(name).cast("string")).alias("level"), col(order).alias("at"))
    return present.groupBy("level").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("first")


def flags(profiled: DataFrame) -> DataFrame:
    """(name, flags): what to look at in each profiled column."""
    share, skew = F.col("missing_share"), F.abs("skew")
    found = F.array_compact(
        F.array(
            F.when(F.col("constant") == 1, F.lit("zero variance")),
            F.when(share > 0.2, F.lit("over 20 % missing")).when(share > 0.05, F.lit("over 5 % missing")),
            F.when(skew > 2, F.lit("very skewed")).when(skew > 1, F.lit("skewed")),
            F.when(F.col("outliers") > 0, F.lit("beyond 3 sd")),
            F.when(F.col("group_code"), F.lit("group code?")),
        )
    )
    return profiled.select("name", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no alerts"))).alias("flags"))


def role_summary(profiled: DataFrame) -> DataFrame:
    """(role, columns): how many columns have each role."""
    return profiled.groupBy("role").agg(F.count("*").alias("columns"))


def change_roles(roles: Mapping[str, str], profiled: DataFrame, change: str) -> dict[str, str]:
    """Roles after a bulk change: ``all-active`` (numeric, not constant), ``active-to-supplementary`` or ``reset``."""
    rows = profiled.select("name", "kind", "constant", "role").collect()
    if change == "reset":
        return {r["name"]: r.role for r in rows}
    if change == "all-active":
        return {r["name"]: "active" if r.kind == "numeric" and not r.constant else roles[r["name"]] for r in rows}
    if change == "active-to-supplementary":
        return {n: "supp-num" if role == "active" else role for n, role in roles.items()}
    raise ValueError(f"no such change: {change}")


def preview(df: DataFrame, rows: int = 12) -> DataFrame:
    """The first rows."""
    return df.limit(rows)
