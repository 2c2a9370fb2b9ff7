"""Ward's tree and silhouettes of rows that stay in Spark, against the exact ones on the driver."""

import numpy as np
import pytest

from multifactor.operators import cluster, hierarchy


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(160, 2)), rng.normal(size=(50, 2)) * 3 + 9, [[50, 50], [52, 53], [-60, 3], [-60, 9]]])
    x = np.concatenate([x, x[:15], x[:15]])  # equal rows
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "_row long, F1 double, F2 double").repartition(3)


@pytest.fixture(scope="module")
def forest(cloud):
    return hierarchy.ward_forest(cloud[1], ["F1", "F2"], "_row", 20, 60)


def test_forest_has_the_exact_heights(cloud, forest):
    x, _ = cloud
    upper = cluster.ward(np.stack(forest.clusters["x"]), forest.clusters["w"].to_numpy())
    lower = forest.merges.toPandas()["height"].to_numpy()
    assert len(forest.clusters) <= 20 and len(lower) + len(upper.heights) + 30 == len(x) - 1
    assert np.allclose(np.sort([*upper.heights, *lower, *[0.0] * 30]), np.sort(cluster.ward(x).heights), rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize("q", [2, 3, 6, 9])
def test_cuts_of_the_crown_equal_the_exact_tree(cloud, forest, q):
    x, _ = cloud
    top = cluster.crown(forest, 10)
    want = cluster.ward(x).cut(q)
    got = {r.id: r.g0 for r in cluster.crown_rows(forest, top, [q]).select("id", "g0").distinct().collect()}
    first = {tuple(p): i for i, p in reversed(list(enumerate(x.tolist())))}
    assert [got[first[tuple(p)]] for p in x.tolist()] == want.tolist() and int(top.tree.sizes[-1]) == len(x)


def test_silhouettes_equal_brute_force(cloud, spark):
    x, _ = cloud
    cuts = [cluster.ward(x).cut(q) for q in (2, 4, 7)] + [np.zeros(len(x), int)]
    rows = spark.createDataFrame([(float(a), float(b), *[int(g[i]) for g in cuts]) for i, (a, b) in enumerate(x)], "F1 double, F2 double, a int, b int, c int, d int")
    want = [cluster.silhouette(x, g) for g in cuts]
    assert hierarchy.silhouettes(rows, ["F1", "F2"], list("abcd"), cell_rows=60) == pytest.approx(want, abs=1e-12)
    assert hierarchy.silhouettes(rows, ["F1", "F2"], list("abcd"), 1e-3, cell_rows=40) == pytest.approx(want, abs=1e-3)
    assert hierarchy.silhouettes(rows.where("false"), ["F1", "F2"], ["a"]) == [0.0]


def test_clustering_beyond_the_driver_equals_that_on_it(cloud, monkeypatch):
    _, rows = cloud
    want = cluster.hcpc(rows, ["F1", "F2"])
    monkeypatch.setattr(cluster, "MOST_POINTS", 40)
    got = cluster.hcpc(rows, ["F1", "F2"])
    assert got.exact and np.allclose(got.centres, want.centres) and got.rules.silhouettes == [(q, pytest.approx(s)) for q, s in want.rules.silhouettes]
    assert (got.rules.jump, got.rules.relative, got.rules.consensus) == (want.rules.jump, want.rules.relative, want.rules.consensus)
    assert not cluster.hcpc(rows, ["F1", "F2"], 3, exact=False).exact


def test_points_in_a_row_at_equal_distances(spark):
    """Ties everywhere: rounds end, and every merge is one of least cost."""
    rows = spark.createDataFrame([(i, float(i)) for i in range(64)], "_row long, F1 double")
    found = hierarchy.ward_forest(rows, ["F1"], "_row", 2, 16)
    assert len(found.clusters) <= 2 and found.clusters["n"].sum() == 64 and found.merges.count() == 64 - len(found.clusters)
    assert found.merges.where("step = 0").select("height").distinct().count() == 1 and found.steps < 16
