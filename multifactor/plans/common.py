"""What the registered queries share: the given tables, derived measures, and rounding that both engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions.columns import col

#: Correlated measures of lineitem, and their SQL.
MEASURES = ["quantity", "price", "discounted", "charge"]
MEASURES_SQL = """li as (select l_orderkey * 10 + l_linenumber as _row, l_returnflag, l_linestatus, l_quantity as quantity, l_extendedprice as price,
  l_extendedprice * (1 - l_discount) as discounted, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge, l_discount, l_tax from lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``_row`` and its correlated measures."""
    price, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_row"), "l_returnflag", "l_linestatus", F.col("l_quantity").alias("quantity"), price.alias("price"),
        net.alias("discounted"), (net * (1 + F.col("l_tax"))).alias("charge"), "l_discount", "l_tax",
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros."""
    return df.select(*[(F.round(col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else col(n) for n, t in df.dtypes])


def as_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small frame of figures."""
    return spark.createDataFrame(rows, schema)
