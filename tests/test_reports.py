"""Figures' data, reports and packages on a small planted table."""

import zipfile
from io import BytesIO

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from multifactor.operators import adequacy, cluster, figures, mixed, prepare, report, rotation
from multifactor.operators.correspondence import correspondence
from multifactor.operators.factor_maps import factor_map
from multifactor.operators.pca import correlation_pca

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(50, 2))
    x = np.hstack([f[:, :1] + 0.3 * rng.normal(size=(50, 2)), f[:, 1:] + 0.3 * rng.normal(size=(50, 2))])
    pdf = pd.DataFrame(x, columns=NAMES)
    pdf.insert(0, "_row", range(50))
    pdf["g"] = np.where(f[:, 0] > 0, "up", "down")
    pdf["extra"] = f[:, 0]
    return spark.createDataFrame(pdf).cache()


def test_analysis_tables(spark, df):
    p = prepare.prepare(df, prepare.Roles(NAMES, ["extra"], ["g"]))
    d = adequacy.diagnose(p)
    a = report.analyse(spark, p, d, replicates=10)
    assert a.k == 2 and len(a.tables) == 18 and all(t.columns for t in a.tables.values())
    assert a.tables["individuals"].count() == 50 and a.tables["supplementary numbers"].where("abs(coord) > 0.9").count() == 1
    z = zipfile.ZipFile(BytesIO(report.packed(a, {"checks.txt": report.diagnostic_text(d)})))
    assert len(z.namelist()) == 18 and z.testzip() is None
    assert isinstance(report.warnings(a, d, 0.1), list) and "overlap" in " ".join(report.warnings(a, d, 0.1))
    text = report.page("A <run>", {"checks": report.diagnostic_text(d), "axes": a.tables["eigenvalues"]})
    assert "&lt;run&gt;" in text and text.count("<tr>") == 5


def test_figures(spark, df):
    found = correlation_pca(df, NAMES)
    m = factor_map(df, found, 2, keep=["_row", "g"])
    assert [r.variable for r in figures.scale_profile(df, NAMES).collect()][0] in NAMES
    heat = figures.correlation_heatmap(spark, found.correlation, NAMES).toPandas()
    order = heat[heat["row"] == heat["col"]].sort_values("row")["a"].tolist()
    assert {frozenset(order[:2]), frozenset(order[2:])} == {frozenset("ab"), frozenset("cd")} or abs(order.index("a") - order.index("b")) in (1, 3)
    assert figures.histogram_grid(df, ["a", "b"]).agg(F.sum("n")).first()[0] == 100
    assert figures.scree(spark, found).count() == 4
    assert figures.loading_heatmap(spark, found.loadings[:, :2], NAMES).count() == 8
    turned = rotation.rotate(found.loadings[:, :2])
    assert figures.loading_plane(spark, found.loadings[:, :2], turned.pattern, NAMES).count() == 4
    assert figures.correlation_circle(spark, m).where("well").count() == 4
    rows, arrows = figures.biplot(spark, m)
    assert rows.count() == 50 and arrows.count() == 4
    points = found.loading_table(spark).withColumnRenamed("variable", "name")
    assert figures.contribution_bars(points, 1, 2).count() == 2 and figures.cos2_heatmap(points).agg(F.max("cumulative")).first()[0] == pytest.approx(1)
    assert figures.test_value_heatmap(m.individuals, ["g"], ["F1", "F2"]).count() == 4 and figures.group_profile(m.individuals, "g", ["F1"]).count() == 2
    both = df.join(found.scores(df, 2), "_row")
    assert figures.dimension_bars(both, NAMES, "F1", 2, significant=True).count() == 2
    ca = correspondence(np.array([[10, 2, 3], [1, 9, 4], [3, 3, 9]]))
    assert figures.point_map(ca.points(spark), n=3).count() == 3
    f = mixed.mfa(df, {"x": ["a", "b"], "y": ["c", "d"]})
    assert figures.partial_map(f.rows(df, 2), f.partial(df, 2, keep=("_row",)), 4).count() == 12
    assert figures.ticks(0, 10) == [0, 2, 4, 6, 8, 10] and figures.ticks(1, 1) == [1] and figures.ticks(-0.3, 0.31, 4)[0] == -0.2
    figures.named({"map_rows": rows})
    assert spark.sql("select count(*) from map_rows").first()[0] == 50


def test_cluster_figures(spark, df):
    h = cluster.hcpc(correlation_pca(df, NAMES).scores(df, 2))
    nodes = figures.dendrogram(spark, h.tree, h.q).toPandas()
    assert len(nodes) == 99 and nodes["cluster"].nunique() == h.q and nodes["x"].between(0, 49).all()
    assert figures.cluster_numbers(spark, h.tree, h.rules.silhouettes).count() == len(h.rules.silhouettes)
    d = cluster.descriptors(h.rows, h.axes, [])
    assert figures.cluster_profile(d, 1).groupBy("cluster").count().where("count > 1").count() == 0
    assert set(report.cluster_tables(h)) == {"clusters", "cluster description", "paragons", "merges"} and "clusters hold" in report.cluster_text(h)
