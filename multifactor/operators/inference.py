"""Correlations, ranks, group tests and contingency tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.functions import columns as C
from multifactor.functions import distributions as D
from multifactor.functions.columns import col
from multifactor.operators.quantiles import group_quantiles, value_ranks, with_ranks
from multifactor.operators.storage import stored


#: Cells of a whole grid, at most.
MOST_CELLS = 10_000_000


def pairwise_correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of different columns: Pearson over rows with both, 0 where one is constant."""
    spark = df.sparkSession
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*[F.coalesce(C.correlation(col(a), col(b)), F.lit(0.0)) for a, b in pairs]).first() if pairs else []
    return spark.createDataFrame([(a, b, float(r)) for (a, b), r in zip(pairs, row, strict=True)], "a string, b string, r double")


def _ranks(rows: DataFrame, values: Sequence[Column]) -> tuple[DataFrame, int]:
    """Ranks of the distinct values of several columns of one type, counted in one pass, and the most rows of a column."""
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), v.alias("_v")) for i, v in enumerate(values)])).alias("x")
    return value_ranks(rows.select(long).where("x._v is not null").groupBy("x").agg(F.count("*").alias("_n")).select("x._c", "x._v", "_n"))


def average_ranks(df: DataFrame, names: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """``df`` with the average rank of each column's values (null for null).

    Columns of one type are ranked together from counts of distinct values; rows then meet their value's rank, those of
    frequent values without moving.
    """
    out, kinds = df, dict(df.dtypes)
    for kind in dict.fromkeys(kinds[n] for n in names):
        chosen = [n for n in names if kinds[n] == kind]
        ranks, total = _ranks(df, [col(n) for n in chosen])
        out = with_ranks(out, ranks, {n + suffix: (i, col(n)) for i, n in enumerate(chosen)}, total)
    return out


def spearman(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlations of average ranks, over rows with all of ``names``; 0 where one is constant.

    All columns are ranked in one pass over counts of distinct values. Rows of frequent values meet their ranks without
    moving, the others by key. Ranks are centred at their known mean, so one aggregation gives all pairs.
    """
    rows = df.dropna(subset=list(names)).select(*[col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    ranks, n = _ranks(rows, [F.col(f"x{i}") for i in range(len(names))])
    ranked = with_ranks(rows, ranks, {f"r{i}": (i, F.col(f"x{i}")) for i in range(len(names))}, n)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    centred = [F.col(f"r{i}") - F.lit((n + 1) / 2) for i in range(len(names))]
    row = ranked.agg(*[F.coalesce(F.sum(centred[i] * centred[j]), F.lit(0.0)) for i, j in pairs]).first()
    s = dict(zip(pairs, row, strict=True))
    r = lambda i, j: float(s[i, j] / math.sqrt(s[i, i] * s[j, j])) if s[i, i] > 0 and s[j, j] > 0 else 0.0
    return df.sparkSession.createDataFrame([(names[i], names[j], r(i, j)) for i, j in pairs if i < j], "a string, b string, r double")


def anova(df: DataFrame, value: str, group: str) -> dict[str, float] | None:
    """One-way analysis of variance; None with fewer than two groups or no freedom left."""
    rows = df.where(col(value).isNotNull() & col(group).isNotNull()).groupBy(col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(col(value)).alias("m"), F.var_pop(col(value)).alias("v"))
    r = rows.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("v")).alias("w")).first()
    if not r.g or r.g < 2 or r.n <= r.g:
        return None
    grand = r.s / r.n
    ssb = rows.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.lit(grand), 2)).alias("b")).first().b
    return anova_figures(ssb, r.w, r.g, r.n)


def anova_figures(ssb: float, ssw: float, groups: int, n: int) -> dict[str, float]:
    """F, its freedom and p, eta2 and omega2 (not below 0) from sums of squares."""
    df1, df2 = groups - 1, n - groups
    msw = ssw / df2
    f = ssb / df1 / msw if msw > 0 else math.inf
    total = ssb + ssw
    omega = (ssb - df1 * msw) / (total + msw) if total + msw > 0 else 0.0
    return {"F": f, "df1": df1, "df2": df2, "p": D.f_tail(f, df1, df2), "eta2": ssb / total if total > 0 else 0.0, "omega2": max(0.0, omega), "ssb": ssb, "ssw": ssw}


def kruskal(df: DataFrame, value: str, group: str) -> dict[str, float] | None:
    """Kruskal-Wallis with average ranks and tie correction; None with fewer than two groups or three values.

    Rows are counted by value and group first, and values are ranked by their counts. Counts of a value that many groups
    have meet its rank without moving, the others by key.
    """
    rows = df.where(col(value).isNotNull() & col(group).isNotNull()).groupBy(col(value).cast("double").alias("_v"), col(group).alias("g")).agg(F.count("*").alias("_n"))
    rows = stored(rows)
    values = rows.groupBy(F.lit(0).alias("_c"), "_v").agg(F.sum("_n").alias("_n"), F.count("*").alias("_m"))
    ranks, total = value_ranks(values, "_m")
    ranks = ranks.withColumn("_tie", F.col("_n").cast("double") * (F.col("_n").cast("double") * F.col("_n") - 1))
    ranked = with_ranks(rows, ranks, {"_rank": (0, F.col("_v"))}, total, "_m")
    sums = ranked.groupBy("g").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_rank")).alias("s"))
    ties = ranks.agg(F.coalesce(F.sum("_tie"), F.lit(0.0))).first()[0]
    r = sums.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).first()
    if not r.g or r.g < 2 or r.n < 3:
        return None
    h = 12 / (r.n * (r.n + 1)) * r.q - 3 * (r.n + 1)
    correction = 1 - ties / (r.n**3 - r.n)
    h = h / correction if correction > 0 else 0.0
    return {"H": h, "df": r.g - 1, "p": D.chi2_tail(h, r.g - 1)}


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): the table of two columns in long form, rows without either left out."""
    return df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def _with_margins(table: DataFrame) -> DataFrame:
    """The filled cells of a long table with the counts of their row and column."""
    rows, cols = table.groupBy("a").agg(F.sum("n").alias("row_n")), table.groupBy("b").agg(F.sum("n").alias("col_n"))
    return table.join(rows, "a").join(cols, "b")


def cells(table: DataFrame, empty: bool = False) -> DataFrame:
    """Cells of a long table: observed, expected, Pearson residual and share of chi-square in %.

    Filled cells are joined to their margins by key. ``empty`` adds the cells without rows: as many as rows times
    columns, which only a reader of the whole grid wants; more than MOST_CELLS are an error.
    """
    figures = chi2_of(table)
    full = _with_margins(table)
    if empty:
        if figures["rows"] * figures["cols"] > MOST_CELLS:
            raise ValueError(f"a grid of {figures['rows']} x {figures['cols']} cells: ask for the filled ones")
        rows, cols = table.groupBy("a").agg(F.sum("n").alias("row_n")), table.groupBy("b").agg(F.sum("n").alias("col_n"))
        full = rows.crossJoin(cols).join(table, ["a", "b"], "left")
    observed = F.coalesce("n", F.lit(0)).cast("double")
    full = full.select("a", "b", observed.alias("observed"), (F.col("row_n") * F.col("col_n") / F.lit(figures["n"] or 1.0)).alias("expected"))
    full = full.withColumn("residual", (F.col("observed") - F.col("expected")) / F.sqrt("expected"))
    share = 100 * F.col("residual") * F.col("residual") / F.lit(figures["chi2"]) if figures["chi2"] > 0 else F.lit(0.0)
    return full.select("a", "b", "observed", "expected", "residual", share.alias("contribution"))


def chi2_of(table: DataFrame) -> dict[str, float]:
    """chi2, df, p, inertia, least expected count, and cells expected under 5 (count, share) of a long table.

    Only filled cells are looked at: chi2 = n (sum of n_ij^2 / (r_i c_j) - 1), and the cells expected under 5 are counted
    from the margins' distinct sizes, of which n rows have at most about sqrt(2 n).
    """
    rows, cols = table.groupBy("a").agg(F.sum("n").alias("row_n")), table.groupBy("b").agg(F.sum("n").alias("col_n"))
    of_rows, of_cols = rows.agg(F.count("*"), F.min("row_n"), F.sum("row_n")).first(), cols.agg(F.count("*"), F.min("col_n")).first()
    n = float(of_rows[2] or 0)
    count = F.col("n").cast("double")
    parts = _with_margins(table).agg(F.sum(count * count / (F.col("row_n").cast("double") * F.col("col_n")))).first()[0] or 0.0
    chi2, k, m = max(0.0, n * (parts - 1)) if n else 0.0, of_rows[0], of_cols[0]
    # a cell is expected under 5 if its column's count is under 5 n / (its row's count)
    bars = rows.groupBy("row_n").agg(F.count("*").alias("m")).select((F.lit(5 * n) / F.col("row_n")).alias("at"), "m", F.lit(1).alias("bar"))
    sizes = cols.groupBy("col_n").agg(F.count("*").alias("m")).select(F.col("col_n").cast("double").alias("at"), "m", F.lit(0).alias("bar"))
    below = F.sum(F.when(F.col("bar") == 0, F.col("m")).otherwise(0)).over(W.orderBy("at", F.desc("bar")))  # distinct sizes only
    low = bars.unionByName(sizes).withColumn("below", below).where("bar = 1").agg(F.sum(F.col("below") * F.col("m"))).first()[0] or 0
    df = max(0, (k - 1) * (m - 1))
    return {"chi2": chi2, "df": df, "p": D.chi2_tail(chi2, df) if df else 1.0, "inertia": chi2 / n if n else 0.0, "n": n, "least_expected": of_rows[1] * of_cols[1] / n if n else 0.0, "low_cells": low, "low_share": low / (k * m) if k * m else 0.0, "rows": k, "cols": m}


def cramer(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, v): Cramer's V of each pair of categorical columns over rows with both, 0 where degenerate.

    One pass counts the filled cells of all pairs, combined in each task; margins are grouping sets of these counts, and
    one job returns a row for each pair.
    """
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, v double")
    label = [col(n).cast("string") for n in names]
    both = F.explode(F.array(*[F.when(label[i].isNotNull() & label[j].isNotNull(), F.struct(F.lit(k).alias("pair"), label[i].alias("a"), label[j].alias("b"))) for k, (i, j) in enumerate(pairs)])).alias("x")
    counts = stored(df.select(both).where("x is not null").groupBy("x").agg(F.count("*").alias("n")).select("x.*", "n"))
    margins = counts.groupingSets([["pair", "a"], ["pair", "b"]], "pair", "a", "b").agg(F.grouping("a").alias("of_b"), F.sum("n").alias("m"))
    rows, cols = margins.where("of_b = 0").select("pair", "a", F.col("m").alias("row_n")), margins.where("of_b = 1").select("pair", "b", F.col("m").alias("col_n"))
    cell = F.col("n").cast("double")
    parts = counts.join(rows, ["pair", "a"]).join(cols, ["pair", "b"]).groupBy("pair").agg(F.sum(cell * cell / (F.col("row_n").cast("double") * F.col("col_n"))).alias("parts"))
    levels = margins.groupBy("pair").agg(F.count_if(F.col("of_b") == 0).alias("rows"), F.count_if(F.col("of_b") == 1).alias("cols"))
    held = {r.pair: r for r in parts.join(levels, "pair").collect()}
    out = []
    for k, (i, j) in enumerate(pairs):
        m = min(held[k].rows, held[k].cols) - 1 if k in held else 0
        out.append((names[i], names[j], math.sqrt(max(0.0, held[k].parts - 1) / m) if m > 0 else 0.0))
    return df.sparkSession.createDataFrame(out, "a string, b string, v double")


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n) of equal width, the last one closed; by default ceil(sqrt n) bins, 5 to 30."""
    x = col(name).cast("double")
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    k = bins or min(30, max(5, math.ceil(math.sqrt(n or 0))))
    width = ((high or 0.0) - (low or 0.0)) / k or 1.0
    place = F.least(F.floor((x - F.lit(low or 0.0)) / F.lit(width)).cast("int"), F.lit(k - 1))
    counted = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    edge = lambda c: F.lit(low or 0.0) + c * F.lit(width)
    return every.join(counted, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def matrix_of(pairs: DataFrame, names: Sequence[str], value: str = "r", diagonal: float = 1.0) -> np.ndarray:
    """A symmetric matrix from the long frame of pairs."""
    place = {n: i for i, n in enumerate(names)}
    out = np.eye(len(names)) * diagonal
    for r in pairs.collect():
        out[place[r.a], place[r.b]] = out[place[r.b], place[r.a]] = r[value]
    return out


def box_summary(df: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and the count outside, by group; quartiles from cumulated counts, however large a group is."""
    x = col(name).cast("double")
    keys = [col(group).alias("group")] if group else [F.lit("all").alias("group")]
    rows = df.where(x.isNotNull()).select(*keys, x.alias("x"))
    q = group_quantiles(rows, F.col("x"), F.col("group"), (0.25, 0.5, 0.75)).select(F.col("_g").alias("g"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("fence_low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("fence_high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    inside: Column = (F.col("x") >= F.col("fence_low")) & (F.col("x") <= F.col("fence_high"))
    met = rows.join(q, rows["group"].eqNullSafe(q["g"]))
    return met.groupBy("group", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"), F.count_if(~inside).alias("outside"))
