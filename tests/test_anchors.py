"""Published figures, and the distributed statistics against brute force on tables with ties, nulls and empty cells."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from multifactor.functions import distributions as D
from multifactor.functions.linalg import eigen_symmetric
from multifactor.operators import adequacy, correspondence, describe, factor_maps, gsvd, inference, quantiles, retention

#: The correlations of Fisher's iris measures (sepal length and width, petal length and width), 150 rows.
IRIS = {(0, 1): -0.1175697841, (0, 2): 0.8717537759, (0, 3): 0.8179411263, (1, 2): -0.4284401043, (1, 3): -0.3661259325, (2, 3): 0.9628654314}


@pytest.fixture(scope="module")
def iris():
    r = np.eye(4)
    for (i, j), v in IRIS.items():
        r[i, j] = r[j, i] = v
    return r


def test_iris_axes(iris):
    values, vectors = eigen_symmetric(iris)
    assert np.allclose(values, [2.918498, 0.914030, 0.146757, 0.020715], atol=1e-5)
    assert np.allclose(vectors[:, 0] * np.sqrt(values[0]) * np.sign(vectors[0, 0]), [0.8902, -0.4601, 0.9916, 0.9650], atol=1e-3)


def test_iris_adequacy(iris):
    sphericity, kmo = adequacy.bartlett(iris, 150), adequacy.kmo(iris)
    assert sphericity["chi2"] == pytest.approx(706.9593, abs=1e-3) and sphericity["df"] == 6 and sphericity["det"] == pytest.approx(0.0081096, abs=1e-6)
    assert sphericity["p"] < 1e-100
    assert kmo["overall"] == pytest.approx(0.540, abs=1e-3) and np.allclose(kmo["msa"], [0.584, 0.270, 0.531, 0.634], atol=1.5e-3)


@pytest.fixture(scope="module")
def troubled(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1.0, 2.0, 2.0, 3.5, None, float(rng.randrange(9))]), rng.choice(["a", "b", "b", "b", "c", None]), rng.choice(["x", "x", "x", "y", "z", "w", None])) for _ in range(400)]
    rows += [(7.0, "rare", "x"), (8.0, "rare", "q")]
    return spark.createDataFrame(rows, "v double, g string, h string").repartition(5), pd.DataFrame(rows, columns=["v", "g", "h"])


def test_chi_square_and_low_cells(troubled):
    df, pdf = troubled
    got = inference.chi2_of(inference.contingency(df, "g", "h"))
    n = pd.crosstab(pdf["g"], pdf["h"]).to_numpy(float)
    e = np.outer(n.sum(1), n.sum(0)) / n.sum()
    assert got["chi2"] == pytest.approx(((n - e) ** 2 / e).sum()) and got["df"] == (n.shape[0] - 1) * (n.shape[1] - 1)
    assert got["low_cells"] == (e < 5).sum() and got["low_share"] == pytest.approx((e < 5).mean()) and got["least_expected"] == pytest.approx(e.min())
    filled = inference.cells(inference.contingency(df, "g", "h"))
    grid = inference.cells(inference.contingency(df, "g", "h"), empty=True)
    assert filled.count() == (n > 0).sum() and grid.count() == n.size and grid.agg(F.sum("contribution")).first()[0] == pytest.approx(100)
    assert grid.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0] == pytest.approx(got["chi2"])
    assert inference.chi2_of(inference.contingency(df.where("false"), "g", "h"))["chi2"] == 0


def test_kruskal_with_ties(troubled):
    df, pdf = troubled
    whole = pdf.dropna(subset=["v", "g"])
    ranks, n = whole["v"].rank(), len(whole)
    h = 12 / (n * (n + 1)) * sum(s.sum() ** 2 / len(s) for _, s in ranks.groupby(whole["g"])) - 3 * (n + 1)
    h /= 1 - sum(t**3 - t for t in whole["v"].value_counts()) / (n**3 - n)
    got = inference.kruskal(df, "v", "g")
    assert got["H"] == pytest.approx(h) and got["df"] == 3 and got["p"] == pytest.approx(D.chi2_tail(h, 3))
    assert inference.kruskal(df.where("g = 'a'"), "v", "g") is None


def test_spearman_with_ties_and_nulls(spark, troubled):
    pdf = troubled[1].assign(w=lambda d: d["v"].fillna(0) * -2 + d.index % 5)
    df = spark.createDataFrame(pdf[["v", "w"]].astype(object).where(pdf[["v", "w"]].notna(), None), "v double, w double").withColumn("k", F.lit(1.0))
    whole = pdf.dropna(subset=["v"])
    got = {(r.a, r.b): r.r for r in inference.spearman(df, ["v", "w", "k"]).collect()}
    assert got["v", "w"] == pytest.approx(whole["v"].rank().corr(whole["w"].rank())) and got["v", "k"] == 0


def test_quantiles_by_group(troubled):
    df, pdf = troubled
    got = {r["_g"]: (r.q0, r.q1, r.q2) for r in quantiles.group_quantiles(df, F.col("v"), F.col("g"), [0.25, 0.5, 1.0]).collect()}
    for name, part in pdf.dropna(subset=["v"]).groupby("g", dropna=False):
        assert got[None if pd.isna(name) else name] == pytest.approx(tuple(np.quantile(part["v"], [0.25, 0.5, 1.0])))
    box = inference.box_summary(df, "v", "g").toPandas().set_index("group")
    for name, part in pdf.dropna(subset=["v"]).groupby("g", dropna=False):
        q1, q3 = np.quantile(part["v"], [0.25, 0.75])
        outside = ((part["v"] < q1 - 1.5 * (q3 - q1)) | (part["v"] > q3 + 1.5 * (q3 - q1))).sum()
        row = box[box.index.isna()].iloc[0] if pd.isna(name) else box.loc[name]
        assert (row["q1"], row["q3"], row["outside"]) == (pytest.approx(q1), pytest.approx(q3), outside)


def test_hulls_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(0)
        points = [(i, float(a), float(b), "uv"[i % 2]) for i, (a, b) in enumerate(rng.normal(size=(300, 2)).round(2))]
        df = spark.createDataFrame([*points, (301, None, 1.0, "u")], "i int, x double, y double, g string").repartition(6)
        got = factor_maps.hulls(df, "x", "y", "g", parts=2).toPandas().sort_values("place")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, ring in got.groupby("group"):
        mine = np.array([(a, b) for _, a, b, g in points if g == name])
        corners = ring[["x", "y"]].to_numpy()
        for p, q in zip(corners, np.roll(corners, -1, axis=0), strict=True):
            assert ((q - p)[0] * (mine[:, 1] - p[1]) - (q - p)[1] * (mine[:, 0] - p[0]) >= -1e-12).all()
        assert {tuple(c) for c in corners} <= {tuple(m) for m in mine}


def test_random_eigenvalues_like_those_of_rows(spark):
    got = retention.parallel_normal(spark, 40, 3, 400).groupBy("axis").agg(F.avg("value").alias("m")).orderBy("axis").toPandas()["m"]
    rng = np.random.default_rng(1)
    want = np.mean([np.linalg.eigvalsh(np.corrcoef(rng.standard_normal((40, 3)).T))[::-1] for _ in range(2000)], axis=0)
    assert np.allclose(got, want, atol=0.02)
    few = retention.parallel_normal(spark, 3, 5, 4).groupBy("replicate").agg(F.sum("value").alias("t")).toPandas()["t"]
    assert np.allclose(few, 5)


def test_levels_are_bounded_and_ordered(spark, monkeypatch):
    df = spark.createDataFrame([(3, "a", "x"), (1, "b", "x"), (2, "c", "y"), (4, "a", "y")], "_row int, k string, l string")
    found = correspondence.correspondence_of(df, "k", "l")
    assert found.rows == ["b", "c", "a"] and found.cols == ["x", "y"] and found.counts.tolist() == [[1, 0], [0, 1], [1, 1]]
    monkeypatch.setattr(gsvd, "MOST_LEVELS", 4)
    with pytest.raises(ValueError, match="levels"):
        gsvd.indicators(df, ["k", "l"])
    monkeypatch.setattr(describe, "MOST_CLUSTERS", 1)
    with pytest.raises(ValueError, match="clusters"):
        describe.category_test_values(df, "k", "l")


@pytest.mark.parametrize(("p", "df"), list(itertools.product((1e-6, 0.05, 0.5, 0.95, 1 - 1e-9), (0.5, 1, 2, 10, 300))))
def test_chi2_quantile_inverts_its_function(p, df):
    assert D.chi2_cdf(D.chi2_quantile(p, df), df) == pytest.approx(p, rel=1e-9)


def test_chi2_quantiles_of_tables():
    assert [round(D.chi2_quantile(0.95, k), 3) for k in (1, 2, 10)] == [3.841, 5.991, 18.307] and D.chi2_quantile(0, 3) == 0
