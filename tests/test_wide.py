"""Axes of tables with many levels against the dense path, and ranks of frequent values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from multifactor.operators import correspondence, inference, quantiles, retention, wide
from multifactor.operators.moments import gram_of_rows


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n))
    base = spark.range(1500).select(F.col("id").alias("_row"), h(1, 40).alias("a"), h(2, 7).alias("x"))
    hot = F.when(F.col("_row") % 3 == 0, F.lit("hot=1")).otherwise(F.concat(F.lit("l"), (F.col("a") % 9).cast("string")))
    return base.select("_row", F.concat(F.lit("a"), "a").alias("a"), hot.alias("b"), (F.col("x") + F.col("a") % 2).cast("string").alias("odd name"), F.when(F.col("x") > 5, None).otherwise(F.col("x")).alias("gap"))


@pytest.mark.parametrize("names,k", [(["a", "b"], 4), (["a", "b", "odd name"], 5), (["b", "gap"], 3), (["b", "b"], 2)])
def test_axes_equal_the_dense_path(spark, rows, names, k):
    got, want = wide.wide_mca(rows, names, k), correspondence.mca(rows.dropna(subset=names), names)
    assert np.allclose(got.values, want.core.values[:k], rtol=0, atol=1e-10) and got.n_levels == len(want.levels)
    assert got.squares == pytest.approx((want.core.values**2).sum()) and got.total == pytest.approx(want.raw_inertia)
    a, b = got.adjusted, want.adjusted
    m = len(a["benzecri"])
    assert np.allclose(a["benzecri"], b["benzecri"][:m]) and np.allclose(a["greenacre_share"], b["greenacre_share"][:m])


def test_points_and_rows_equal_the_dense_path(spark, rows):
    names = ["a", "b", "odd name"]
    got, want = wide.wide_mca(rows, names, 4), correspondence.mca(rows, names)
    mine = got.rows(rows).orderBy("_row").toPandas()
    theirs = want.rows(rows, 4).orderBy("_row").toPandas()
    for axis in range(1, 5):
        turn = np.sign((mine[f"F{axis}"] * theirs[f"F{axis}"]).sum())
        assert np.allclose(mine[f"F{axis}"], turn * theirs[f"F{axis}"], atol=1e-8)
    points = got.categories().toPandas().set_index(["variable", "level", "axis"])
    both = points.join(want.categories(spark).toPandas().set_index(["variable", "level", "axis"]), rsuffix="_w", how="inner")
    assert len(both) == 4 * got.n_levels and np.allclose(both["coord"].abs(), both["coord_w"].abs(), atol=1e-8) and np.allclose(both["contribution"], both["contribution_w"], atol=1e-6)
    strange = got.rows(rows.limit(1).withColumn("a", F.lit("never seen")).withColumn("b", F.lit(None).cast("string")))
    assert strange.count() == 1 and strange.first()["F1"] is not None


def test_correspondence_equals_the_dense_path(spark, rows):
    got, want = wide.wide_correspondence(rows, "a", "b", 3), correspondence.correspondence_of(rows, "a", "b")
    assert np.allclose(got.values, want.values[:3]) and got.chi2 == pytest.approx(want.chi2) and got.inertia == pytest.approx(want.inertia)
    theirs = {(p["side"], p["name"], p["axis"]): p for p in want.points(spark).where("axis <= 3").collect()}
    for p in got.points.collect():
        for axis in (1, 2, 3):
            t = theirs[p["side"], p["name"], axis]
            assert abs(p["x"][axis - 1]) == pytest.approx(abs(t["coord"]), abs=1e-8) and p["mass"] == pytest.approx(t["mass"])


def test_wide_refuses_what_has_no_axis(spark, rows):
    for df, names in ((rows, ["a"]), (rows.where("false"), ["a", "b"]), (rows.withColumn("one", F.lit(1)).withColumn("two", F.lit(2)), ["one", "two"])):
        with pytest.raises(ValueError):
            wide.wide_mca(df, names)


def test_gram_of_rows_adds_all_tasks(spark):
    x = np.arange(60, dtype=float).reshape(20, 3) % 7
    rows = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").repartition(5)
    assert np.allclose(gram_of_rows(rows, 3), x.T @ x) and np.allclose(gram_of_rows(rows.where("false"), 3), 0)


def test_ranks_of_frequent_values_need_no_key(spark):
    """A flag beside a continuous column: rows of the flag's values move to no key, and no other value is frequent."""
    rows = spark.range(4000).select((F.col("id") % 2).cast("double").alias("flag"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 7919 % 4001 / 3.0).alias("x"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 11).alias("gap"))
    ranks, total = inference._ranks(rows, [F.col("flag"), F.col("x")])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = ranks.groupBy("_c").agg(F.sum(F.when(F.col("_n") >= total / (4 * parts), 1).otherwise(0)).alias("heavy"), F.max(F.when(F.col("_n") < total / (4 * parts), F.col("_n"))).alias("light")).orderBy("_c").collect()
    assert [r.heavy for r in held] == [2, 1] and held[1].light == 1 and total == 4000
    dealt = ranks.select("_c", "_v").count()
    assert dealt == 2 + rows.select("x").distinct().count()
    got = inference.average_ranks(rows, ["flag", "x", "gap"]).toPandas()
    for c in ("flag", "x", "gap"):
        assert np.allclose(got[f"{c}_rank"], got[c].rank(), equal_nan=True)
    full = rows.dropna().toPandas()
    want = full.rank().corr()
    for r in inference.spearman(rows, ["flag", "x", "gap"]).collect():
        assert r.r == pytest.approx(want.loc[r.a, r.b])


def test_kruskal_of_one_value_in_many_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("v"), (F.col("id") % 700).alias("g"))
    pandas = rows.toPandas()
    ranks, n = pandas["v"].rank(), len(pandas)
    h = 12 / (n * (n + 1)) * sum(g.sum() ** 2 / len(g) for _, g in ranks.groupby(pandas["g"])) - 3 * (n + 1)
    tie = 1 - sum(c**3 - c for c in pandas["v"].value_counts()) / (n**3 - n)
    got = inference.kruskal(rows, "v", "g")
    assert got["H"] == pytest.approx(h / tie) and got["df"] == 699


def test_cramer_of_all_pairs_equals_chi_square_of_each(spark, rows):
    names = ["a", "b", "odd name", "gap"]
    for r in inference.cramer(rows.withColumn("one", F.lit("x")), [*names, "one"]).collect():
        f = inference.chi2_of(inference.contingency(rows.withColumn("one", F.lit("x")), r.a, r.b))
        m = min(f["rows"], f["cols"]) - 1
        assert r.v == pytest.approx((f["chi2"] / (f["n"] * m)) ** 0.5 if m else 0.0)
    assert inference.cramer(rows, ["a"]).count() == 0


def test_value_ranks_of_an_empty_table(spark):
    none = spark.createDataFrame([], "_c int, _v double, _n long")
    ranks, total = quantiles.value_ranks(none)
    assert ranks.count() == 0 and total == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 1000, 4097])
def test_keyed_permutations_are_permutations(n):
    one, two = (retention.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(one) == sorted(two) == list(range(n)) and (n < 60 or (one != two).mean() > 0.9)
    assert (retention.permuted(np.arange(n)[::-1], n, 1)[::-1] == one).all()  # each number by itself


def test_permuted_columns_keep_their_values(spark):
    """Variances stay, correlations go: the trace of every replicate is that of the table."""
    rows = spark.range(0, 3000, 1, 7).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("c", F.col("a") * 2)
    found = retention.parallel_permuted(rows, ["a", "b", "c"], 4).toPandas()
    want = rows.agg(*[F.var_samp(c) for c in "abc"]).first()
    assert np.allclose(found.groupby("replicate")["value"].sum(), sum(want)) and sorted(found["replicate"].unique()) == [0, 1, 2, 3]
    assert found[found.axis == 1]["value"].max() < 1.15 * want[2]  # a and c alone would give 1.25 times that of c


@pytest.mark.parametrize("p", [2, 5, 40])
def test_downdates_give_the_partial_correlations(p):
    rng = np.random.default_rng(p)
    r = np.corrcoef(rng.normal(size=(500, p)) + rng.normal(size=(500, 1)), rowvar=False)
    values, vectors = np.linalg.eigh(r)
    values, vectors, off = values[::-1], vectors[:, ::-1], ~np.eye(p, dtype=bool)
    for m, f, f4 in retention.velicer(r)["series"]:
        left = r - (vectors[:, :m] * values[:m]) @ vectors[:, :m].T
        c = left / np.sqrt(np.outer(np.diag(left), np.diag(left)))
        assert f == pytest.approx((c[off] ** 2).mean()) and f4 == pytest.approx((c[off] ** 4).mean())
