"""Exact quantiles and ranks that hold at any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.operators.storage import stored

#: Up to so many rows Spark's exact percentile, which holds a column's distinct values, is used in one aggregation.
IN_ONE_AGGREGATION = 5_000_000
#: Approximate quantiles are off by one row in so many at most.
ACCURACY = 10_000


def _in_cells(counts: DataFrame) -> DataFrame:
    """``counts`` (with ``_v``) and the cell that each value falls into, between approximate quantiles of the values."""
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = counts.agg(F.percentile_approx("_v", F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), 1000).alias("c")).first().c if parts > 1 else None
    cut = F.array(*[F.lit(float(c)) for c in cuts or []]).cast("array<double>")
    return counts.withColumn("_cell", F.size(F.filter(cut, lambda c: c < F.col("_v"))))


def cumulative_counts(df: DataFrame, x: Column, group: Column | None = None) -> DataFrame:
    """(_v, _n, _past): each distinct non-null value, its rows, and the rows with smaller values; by ``group``: with ``_g``.

    Distinct values fall into cells between approximate quantiles; sums over the few cells and inside each cell give
    the rest, so no window holds all values, nor all of a group.
    """
    keys = [] if group is None else ["_g"]
    counts = df.where(x.isNotNull()).groupBy(*([] if group is None else [group.alias("_g")]), x.alias("_v")).agg(F.count("*").alias("_n"))
    dealt = _in_cells(counts)
    before = dealt.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_m"))
    over_cells = (W.partitionBy(*keys) if keys else W).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    before = before.select(*keys, "_cell", F.coalesce(F.sum("_m").over(over_cells), F.lit(0)).alias("_before"))
    inner = W.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    before = before if keys else F.broadcast(before)  # a row for each cell
    summed = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(before, [*keys, "_cell"])
    return summed.select(*keys, "_v", "_n", (F.col("_before") + F.col("_in")).alias("_past"))


def value_ranks(counts: DataFrame, met: str = "_n") -> tuple[DataFrame, int]:
    """``counts`` (_c: a number for each column, _v: its distinct values, _n: rows of a value) with ``_rank``, the average rank.

    Also the largest sum of ``met`` over a column's values.

    All columns are ranked together: values are dealt by range of (column, value), and sums over parts and inside each
    part give the rest. A value is one row however often it occurs, so parts hold as many rows as one another.
    """
    dealt = stored(counts.repartitionByRange("_c", "_v").withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_c", "_part").agg(F.sum("_n").alias("_m"))
    before = before.select("_c", "_part", F.coalesce(F.sum("_m").over(W.partitionBy("_c").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_part", "_c").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("_in", inside).join(F.broadcast(before), ["_c", "_part"])  # a row for each part and column at most
    total = dealt.groupBy("_c").agg(F.sum(met).alias("m")).agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    return ranked.select(*counts.columns, (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2).alias("_rank")), total


def with_ranks(rows: DataFrame, ranks: DataFrame, columns: Mapping[str, tuple[int, Column]], total: int, met: str = "_n") -> DataFrame:
    """``rows`` with a column for each of ``columns`` (its number in ``ranks`` and its values): the rank of the value, null for null.

    Values of at least a quarter of a task's share of the ``total`` rows (``met`` holds a value's rows here) are few: they
    are broadcast. Rows of the others meet their rank by key, and none of those keys is frequent.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bar = max(1.0, total / (4 * max(1, parts)))
    out = rows
    for name, (number, value) in columns.items():
        one = ranks.where(F.col("_c") == number)
        heavy = one.where(F.col(met) >= bar).select(F.col("_v").alias("_hv"), F.col("_rank").alias("_hr"))  # 4 values a task at most
        light = one.where(F.col(met) < bar).select(F.col("_v").alias("_lv"), F.lit(0).cast("long").alias("_ls"), F.col("_rank").alias("_lr"))
        out = out.withColumn("_x", value).join(F.broadcast(heavy), F.col("_x") == F.col("_hv"), "left")
        alone = F.col("_x").isNull() | F.col("_hr").isNotNull()  # these rows match nothing below, and are dealt out by number
        out = out.withColumn("_key", F.when(~alone, F.col("_x"))).withColumn("_salt", F.when(alone, F.monotonically_increasing_id()).otherwise(0))
        out = out.join(light, (F.col("_key") == F.col("_lv")) & (F.col("_salt") == F.col("_ls")), "left")
        out = out.withColumn(name, F.coalesce("_hr", "_lr")).drop("_x", "_hv", "_hr", "_key", "_salt", "_lv", "_ls", "_lr")
    return out


def _counted(df: DataFrame, x: Column, group: Column, probabilities: Sequence[float]) -> DataFrame:
    """``group_quantiles`` from cumulated counts of all distinct values."""
    held = cumulative_counts(df, x.cast("double"), F.struct(group.alias("g")))  # a struct, so that a null group meets itself
    held = held.join(held.groupBy("_g").agg(F.sum("_n").alias("_all")), "_g")
    out = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_all") - 1)
        low, part = F.floor(place), place - F.floor(place)
        at = lambda k: F.max(F.when((F.col("_past") <= k) & (k < F.col("_past") + F.col("_n")), F.col("_v")))
        low_v, high_v = at(low), at(F.least(low + 1, F.col("_all") - 1))
        out.append((low_v + F.max(part) * (high_v - low_v)).alias(f"q{i}"))
    return held.groupBy("_g").agg(*out).withColumn("_g", F.col("_g.g"))


def _between(df: DataFrame, columns: Sequence[Column], group: Column, probabilities: Sequence[float]) -> DataFrame | None:
    """Stored (_g, c0_q0, c0_q1, ..., c1_q0, ...): exact quantiles (type 7) of each group's non-null numbers in each column.

    One pass finds values on both sides of each quantile by approximation, one counts the rows below, and one counts the
    distinct values between, which are about 4 of ACCURACY rows; only these are sorted. Groups of up to 10 x ACCURACY numbers
    are counted as a whole, once. None if an approximation did not hold.
    """
    wide = 2 / ACCURACY
    sides = F.array(*[F.lit(min(1.0, max(0.0, float(p) + d))) for p in probabilities for d in (-wide, wide)])
    rows = df.select(group.alias("_g"), *[x.cast("double").alias(f"x{k}") for k, x in enumerate(columns)])
    number = lambda k, j: k * len(probabilities) + j
    each = [(k, j) for k in range(len(columns)) for j in range(len(probabilities))]
    near = rows.groupBy("_g").agg(*[f for k in range(len(columns)) for f in (F.count(f"x{k}").alias(f"n{k}"), F.percentile_approx(f"x{k}", sides, F.lit(ACCURACY)).alias(f"s{k}"))])
    side = lambda k, j, high: F.when(F.col(f"n{k}") > 10 * ACCURACY, F.element_at(f"s{k}", 2 * j + high + 1))
    near = stored(near.select("_g", *[f"n{k}" for k in range(len(columns))], *[side(k, j, high).alias(f"{'lh'[high]}{number(k, j)}") for k, j in each for high in (0, 1)]))
    met = rows.join(near, "_g")
    below = met.groupBy("_g").agg(*[F.count_if(F.col(f"x{k}") < F.col(f"l{number(k, j)}")).alias(f"b{number(k, j)}") for k, j in each])
    within = lambda k, j: F.col(f"x{k}").isNotNull() & F.coalesce((F.col(f"x{k}") >= F.col(f"l{number(k, j)}")) & (F.col(f"x{k}") <= F.col(f"h{number(k, j)}")), F.lit(j == 0))
    some = reduce(lambda a, b: a | b, [within(k, j) for k, j in each])
    cells = F.explode(F.filter(F.array(*[F.when(within(k, j), F.struct(F.lit(number(k, j)).alias("c"), F.col(f"x{k}").alias("v"))) for k, j in each]), lambda s: s.isNotNull()))
    counts = met.where(some).select("_g", cells.alias("s")).groupBy("_g", "s.c", "s.v").agg(F.count("*").alias("n"))
    base = near.join(below, "_g").select("_g", F.explode(F.array(*[F.struct(F.lit(number(k, j)).alias("i"), F.when(F.col(f"n{k}") > 10 * ACCURACY, number(k, j)).otherwise(number(k, 0)).alias("c"), F.col(f"n{k}").alias("all"), F.col(f"b{number(k, j)}").alias("below"), F.lit(float(probabilities[j])).alias("p")) for k, j in each])).alias("s")).select("_g", "s.*")
    past = F.coalesce(F.sum("n").over(W.partitionBy("_g", "c").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("p") * (F.col("all") - 1)
    low = F.floor(place)
    high = F.when(place > low, low + 1).otherwise(low)
    at = lambda i: F.max(F.when((F.col("past") <= i) & (i < F.col("past") + F.col("n")), F.col("v")))
    held = counts.withColumn("inner", past).join(base, ["_g", "c"]).withColumn("past", F.col("below") + F.col("inner"))
    found = held.groupBy("_g", "i").agg(at(low).alias("lv"), at(high).alias("hv"), F.first(place - low).alias("part"))
    whole = base.join(found, ["_g", "i"], "left").withColumn("q", F.when(F.col("part") == 0, F.col("lv")).otherwise(F.col("lv") + F.col("part") * (F.col("hv") - F.col("lv"))))
    out = stored(whole.groupBy("_g").agg(F.count_if((F.col("all") > 0) & (F.col("lv").isNull() | F.col("hv").isNull())).alias("_missed"), *[F.max(F.when(F.col("i") == number(k, j), F.col("q"))).alias(f"c{k}_q{j}") for k, j in each]))
    return None if out.where("_missed > 0").limit(1).count() else out.drop("_missed")


def group_quantiles(df: DataFrame, x: Column, group: Column, probabilities: Sequence[float]) -> DataFrame:
    """(_g, q0, q1, ...): exact quantiles (type 7) of each group's non-null numbers."""
    held = F.struct(group.alias("g"))  # a struct, so that a null group meets itself
    found = _between(df.where(x.isNotNull()), [x], held, probabilities)
    if found is None:
        return _counted(df, x, group, probabilities)
    return found.select(F.col("_g.g").alias("_g"), *[F.col(f"c0_q{j}").alias(f"q{j}") for j in range(len(probabilities))])


def _selected(df: DataFrame, x: Column, probabilities: Sequence[float], n: int) -> list[float | None]:
    """Linear-interpolation quantiles of n values by their ranks: at most two values for each reach the driver."""
    if not n:
        return [None] * len(probabilities)
    places = sorted({int(p * (n - 1)) + d for p in probabilities for d in (0, 1) if int(p * (n - 1)) + d < n})
    found = cumulative_counts(df, x).withColumn("_places", F.filter(F.array(*[F.lit(i) for i in places]), lambda i: (F.col("_past") <= i) & (i < F.col("_past") + F.col("_n"))))
    at = {i: float(r._v) for r in found.where(F.size("_places") > 0).collect() for i in r._places}
    out = []
    for p in probabilities:
        low = int(p * (n - 1))
        part = p * (n - 1) - low
        out.append(at[low] if part == 0 else at[low] + part * (at[low + 1] - at[low]))
    return out


def quantiles(df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles (type 7) of each column's non-null numbers."""
    if not columns:
        return {}
    counts = df.agg(*[F.count(x) for x in columns.values()]).first()
    if max(counts) <= IN_ONE_AGGREGATION:
        row = df.agg(*[F.percentile(x.cast("double"), F.array(*[F.lit(float(p)) for p in probabilities])) for x in columns.values()]).first()
        return {name: list(q) if q else [None] * len(probabilities) for name, q in zip(columns, row, strict=True)}
    if (found := _between(df, list(columns.values()), F.lit(0), probabilities)) is not None:
        row = found.first()
        return {name: [row[f"c{k}_q{j}"] for j in range(len(probabilities))] for k, name in enumerate(columns)}
    return {name: _selected(df, x.cast("double"), probabilities, n) for (name, x), n in zip(columns.items(), counts, strict=True)}
