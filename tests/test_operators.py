"""Operators against textbook figures, numpy on the same rows, and the methods' own identities."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from multifactor.operators import adequacy, cluster, correspondence, describe, factor_maps, gsvd, inference, methods, mixed, moments, prepare, profile, quantiles, recommend, retention, rotation
from multifactor.operators.pca import correlation_pca, pca, standardised

RNG = np.random.default_rng(7)
N = 60
LATENT = RNG.normal(size=(N, 2))
DATA = np.hstack([LATENT[:, :1] + 0.3 * RNG.normal(size=(N, 3)), LATENT[:, 1:] + 0.4 * RNG.normal(size=(N, 2))])
NAMES = ["a", "b", "c", "d", "e"]
GROUP = [("x", "y", "z")[int(v > -0.5) + int(v > 0.5)] for v in LATENT[:, 0]]
SIDE = ["left" if v > 0 else "right" for v in LATENT[:, 1] + 0.5 * RNG.normal(size=N)]


@pytest.fixture(scope="module")
def df(spark):
    pdf = pd.DataFrame(DATA, columns=NAMES)
    pdf.insert(0, "_row", range(N))
    pdf["g"], pdf["s"] = GROUP, SIDE
    return spark.createDataFrame(pdf).repartition(3).cache()


@pytest.fixture(scope="module")
def z(df):
    return standardised(df, NAMES)


def coordinates(frame, k=None):
    pdf = frame.orderBy("_row").toPandas()
    return pdf[[c for c in pdf.columns if c.startswith("F")][:k]].to_numpy()


def test_gram_both_ways(df, monkeypatch):
    m = moments.moments(df, NAMES)
    assert np.allclose(m.mean, DATA.mean(0)) and np.allclose(m.sd, DATA.std(0, ddof=1))
    want = (DATA - DATA.mean(0)).T @ (DATA - DATA.mean(0))
    for most in (32, 2):
        monkeypatch.setattr(moments, "EXPRESSION_COLUMNS", most)
        g, n = moments.gram(df, [F.col(c) for c in NAMES], m.mean)
        assert np.allclose(g, want) and n == N


def test_profile_kinds_and_roles(spark):
    rows = [(i, f"id{i}", "5", ["a", "b"][i % 2], str(i % 3), str(i * 1.5) if i != 4 else "NA", f"t{i % 40}") for i in range(60)]
    df = spark.createDataFrame(rows, "_row long, name string, same string, kind string, code string, x string, many string")
    got = {r.name: r for r in profile.profile(df).collect()}
    assert {n: r.role for n, r in got.items()} == {"name": "id", "same": "excluded", "kind": "supp-cat", "code": "supp-cat", "x": "active", "many": "excluded"}
    assert got["x"].missing == 1 and got["x"].n == 59 and got["code"].group_code and got["x"].kind == "numeric" and got["kind"].kind == "categorical"
    assert {r["name"]: r["flags"] for r in profile.flags(profile.profile(df)).collect()}["same"] == ["zero variance"]
    assert [r.level for r in profile.levels(df, "kind").collect()] == ["a", "b"]
    roles = {n: r.role for n, r in got.items()}
    assert profile.change_roles(roles, profile.profile(df), "all-active")["code"] == "active"
    assert profile.change_roles(roles, profile.profile(df), "active-to-supplementary")["x"] == "supp-num"
    assert sum(r["columns"] for r in profile.role_summary(profile.profile(df)).collect()) == 6 and profile.preview(df).count() == 12


@pytest.mark.parametrize("how", prepare.SCALINGS)
def test_scalings(df, how):
    x = DATA[:, 0]
    mad = 1.4826 * np.median(np.abs(x - np.median(x)))
    sd, mean = x.std(ddof=1), x.mean()
    want = {"none": x, "center": x - mean, "z": (x - mean) / sd, "pareto": (x - mean) / sd**0.5, "vast": (x - mean) / (sd**2 / mean), "range": (x - x.min()) / (x.max() - x.min()), "robust": (x - np.median(x)) / mad}[how]
    got = prepare.prepare(df, prepare.Roles(NAMES), scaling=how).frame.orderBy("_row").toPandas()
    assert np.allclose(got["a"], want) and np.allclose(got["raw:a"], x)


def test_preparation_of_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0, 10.0, "p"), (1, None, 20.0, None), (2, 3.0, 60.0, "q"), (3, None, None, "p"), (4, 5.0, 30.0, "q")], "_row long, x double, y double, c string")
    roles = prepare.Roles(["x", "y"], (), ["c"])
    assert prepare.prepare(df, roles, scaling="none").n == 3
    for how, fill in (("mean", 3.0), ("median", 3.0)):
        p = prepare.prepare(df, roles, missing=how, scaling="none")
        assert p.n == 4 and p.imputed == {"x": 1, "y": 0} and {r._row: r.x for r in p.frame.collect()}[1] == fill
        assert p.missing_share == pytest.approx(1 - np.mean([1, 1 / 3, 1, 1 / 3, 1]))
    with pytest.raises(ValueError, match="fewer than 3"):
        prepare.prepare(df.limit(2), roles)
    assert prepare.prepare(df, roles, transform="log", scaling="none").shifted == []
    assert [r._id for r in prepare.prepare(df, roles).frame.orderBy("_row").collect()] == ["Ind 1", "Ind 3", "Ind 5"]


def test_textbook_anova_and_kruskal(spark):
    rows = [("a", 4.0), ("a", 5.0), ("a", 6.0), ("b", 6.0), ("b", 7.0), ("b", 8.0), ("c", 8.0), ("c", 9.0), ("c", 10.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    f = inference.anova(df, "v", "g")
    assert (f["ssb"], f["ssw"], f["F"], f["eta2"]) == pytest.approx((24, 6, 12, 0.8))
    h = inference.kruskal(df, "v", "g")
    ranks = pd.Series([v for _, v in rows[:9]]).rank()
    q = sum(ranks[i : i + 3].sum() ** 2 / 3 for i in (0, 3, 6)) * 12 / 90 - 30
    ties = 1 - (6 + 6) / (9**3 - 9)
    assert h["H"] == pytest.approx(q / ties) and inference.anova(df.where("g = 'a'"), "v", "g") is None and inference.kruskal(df.limit(1), "v", "g") is None


def test_ranks_and_correlations(df, spark):
    ties = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 1, 2, 3, 3, None or 9])], "_row long, v double")
    got = inference.average_ranks(ties, ["v"]).orderBy("_row").toPandas()["v_rank"].tolist()
    assert got == [5.0, 1.5, 1.5, 3.0, 5.0, 5.0, 7.0]
    want = pd.DataFrame(DATA, columns=NAMES)
    assert np.allclose(inference.matrix_of(inference.spearman(df, NAMES), NAMES), want.corr("spearman")) and np.allclose(inference.matrix_of(inference.pairwise_correlations(df, NAMES), NAMES), want.corr())
    assert inference.pairwise_correlations(ties.withColumn("k", F.lit(1.0)), ["v", "k"]).first().r == 0.0


def test_adequacy(df):
    p = prepare.prepare(df, prepare.Roles(NAMES))
    d = adequacy.diagnose(p)
    r = np.corrcoef(DATA.T)
    assert np.allclose(d.r, r) and d.bartlett["chi2"] == pytest.approx(-((N - 1) - 15 / 6) * np.log(np.linalg.det(r)))
    inv = np.linalg.inv(r)
    partial = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(5, dtype=bool)
    assert d.kmo["overall"] == pytest.approx((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum()))
    x = DATA - DATA.mean(0)
    d2 = np.einsum("ij,jk,ik->i", x, np.linalg.inv(np.cov(DATA.T)), x)
    assert np.allclose(adequacy.mahalanobis(df, NAMES).orderBy("_row").toPandas()["d2"], d2)
    assert len(adequacy.advice(d)) == 10 and d.grade in "ABCD" and 0 <= d.score <= 100 and d.grade == adequacy.grade(d.score)
    assert adequacy.bartlett(np.ones((2, 2)), 10)["singular"] and adequacy.kmo(np.ones((2, 2))) is None
    assert adequacy.suitability(200, 5, 0.85, {"p": 0.01, "det": 0.1, "singular": False}, 0.0) == 100
    assert [adequacy.msa_verdict(v) for v in (0.85, 0.75, 0.65, 0.55, 0.4)] == ["very good", "good", "fair", "poor", "unacceptable"]


def test_components(spark, z):
    p = pca(z, NAMES)
    values = np.linalg.eigvalsh(np.corrcoef(DATA.T))[::-1]
    assert np.allclose(p.values, values) and p.is_correlation and p.cumulative[-1] == pytest.approx(1)
    assert np.allclose((p.loadings**2).sum(1), 1) and np.allclose((p.loadings**2).sum(0), values)
    f = coordinates(p.scores(z))
    assert np.allclose(f.var(0, ddof=1), values) and np.allclose(np.cov(f.T), np.diag(values), atol=1e-9)
    assert p.axes(spark).count() == 5 and p.communalities(spark, 2).where("poor").count() <= 5


def test_components_of_unscaled_columns(df, z):
    one, two = correlation_pca(df.withColumn("k", F.lit(3.0)), [*NAMES, "k"]), pca(z, NAMES)
    assert np.allclose(one.values[:5], two.values) and np.allclose(one.loadings[:5, :5], two.loadings, atol=1e-6) and not one.is_correlation
    assert np.allclose(coordinates(correlation_pca(df, NAMES).scores(df)), coordinates(two.scores(z)))


@pytest.mark.parametrize("most", [10**6, 1])
def test_quantiles(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "IN_ONE_AGGREGATION", most)
    x = [float(v) for v in RNG.integers(0, 40, 301)]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double").repartition(3)
    got = quantiles.quantiles(df, {"x": F.col("x"), "none": F.lit(None).cast("double")}, [0, 0.1, 0.25, 0.5, 0.97, 1])
    assert got["x"] == pytest.approx(np.quantile(x, [0, 0.1, 0.25, 0.5, 0.97, 1])) and got["none"] == [None] * 6


def test_retention(spark, z):
    p = pca(z, NAMES)
    assert retention.broken_stick(3, 3.0) == pytest.approx([11 / 6, 5 / 6, 1 / 3])
    assert retention.elbow([5, 2, 1.9, 1.8]) == 2 and retention.elbow([2, 1]) == 1 and retention.reaching([0.5, 0.75, 1.0], 0.7) == 2
    draws = retention.parallel_summary(retention.parallel_normal(spark, N, 5, 12)).orderBy("axis").toPandas()
    assert draws["mean"].sum() == pytest.approx(5) and (draws["p95"] >= draws["mean"]).all() and draws["p95"][0] < p.values[0]
    permuted = retention.parallel_permuted(z, NAMES, 2)
    assert permuted.groupBy("replicate").agg(F.sum("value").alias("t")).where("abs(t - 5) > 1e-6").count() == 0
    rules = retention.criteria(p, draws["p95"])
    assert len(rules) == 8 and retention.consensus(rules) == 2
    assert retention.consensus([retention.Criterion("a", 3, 2), retention.Criterion("b", 2, 2)]) == 2
    assert retention.velicer(p.correlation)["k"] == 2 and retention.velicer(np.eye(4))["series"][0][1] == 0
    assert retention.eigenvalue_table(spark, p, 2, draws["p95"]).where("retained").count() == 2


def test_rotations(spark):
    angle = np.deg2rad(30)
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    simple = np.array([[0.9, 0], [0.8, 0], [0.7, 0], [0, 0.85], [0, 0.75], [0, 0.65]])
    for method in ("varimax", "quartimax", "equamax", "parsimax"):
        r = rotation.rotate(simple @ turn, method)
        assert np.allclose(np.sort(np.abs(r.pattern), axis=1)[:, 0], 0, atol=1e-4) and r.converged
        assert np.allclose((r.pattern**2).sum(1), (simple**2).sum(1)) and np.allclose(simple @ turn @ r.transform, r.pattern)
    a, b = rotation.rotate(simple @ turn, "quartimin"), rotation.rotate(simple @ turn, "oblimin", delta=0)
    assert np.allclose(a.pattern, b.pattern)
    for method in rotation.OBLIQUE:
        r = rotation.rotate(simple @ turn, method)
        assert np.allclose(np.diag(r.phi), 1) and np.allclose(r.structure, r.pattern @ r.phi) and np.allclose(r.pattern @ r.phi @ r.pattern.T, simple @ simple.T, atol=1e-6)
    grid = [(np.cos(t), np.sin(t)) for t in np.linspace(0, np.pi, 721)]
    loadings = RNG.normal(size=(8, 2))
    best = max((lambda m: (((loadings @ m) ** 4).sum() - ((loadings @ m) ** 2).sum(0).dot(((loadings @ m) ** 2).sum(0)) / 8))(np.array([[c, -s], [s, c]])) for c, s in grid)
    got = rotation.rotate(loadings, "varimax", normalize=False).pattern
    assert ((got**4).sum() - (got**2).sum(0) @ (got**2).sum(0) / 8) >= best - 1e-6
    assert rotation.rotate(simple, "none").iterations == 0
    kinds = {r.variable: r.kind for r in rotation.diagnostics(spark, rotation.rotate(simple @ turn, "varimax"), list("abcdef")).collect()}
    assert set(kinds.values()) == {"clean"}
    assert rotation.variance_table(spark, np.array([2.0, 1.0]), rotation.rotate(simple @ turn), 6).count() == 2 and rotation.phi_table(spark, a).count() == 4


def test_factor_maps(spark, z):
    p = pca(z, NAMES)
    m = factor_maps.factor_map(z, p, 2, keep=["_row", "g", "s"])
    t = m.individual_table().toPandas()
    assert t["contribution_1"].sum() == pytest.approx(100) and ((t["cos2_1"] + t["cos2_2"]) <= 1 + 1e-9).all()
    for method in ("varimax", "oblimin"):
        r = rotation.rotate(p.loadings[:, :2], method)
        f = factor_maps.factor_map(z, p, 2, r, keep=["_row"])
        assert np.allclose(coordinates(f.individuals, 2).var(0, ddof=1), r.ss)
    assert m.variable_table(spark).groupBy("variable").agg(F.sum("cos2").alias("c")).where("c > 1 + 1e-9").count() == 0
    own = factor_maps.supplementary_numeric(z.join(p.scores(z, 2, keep=["_row"]), "_row"), ["a"], ["F1", "F2"]).orderBy("axis").toPandas()
    assert np.allclose(own["coord"], p.loadings[0, :2])
    levels = factor_maps.supplementary_levels(m.individuals, "g", ["F1"]).toPandas()
    assert (levels["n"] * levels["F1"]).sum() == pytest.approx(0, abs=1e-9)
    assert factor_maps.top_individuals(m).count() == 12 and factor_maps.plane_summary(m).first().variables == 1.0 and factor_maps.biplot_scale(m) > 0
    assert [r.band for r in factor_maps.quality(spark, m).collect()][0] == "very good"
    assert factor_maps.extremes(m.individuals, ["F1"], 3).where("end = 'low'").count() == 3


def test_geometry(spark):
    pts = [("g", float(x), float(y)) for x, y in itertools.product(range(5), range(4))] + [("h", 0.0, 0.0), ("h", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g string, x double, y double").repartition(4)
    ring = {(r.x, r.y) for r in factor_maps.hulls(df, "x", "y", "g").where("group = 'g'").collect()}
    assert ring == {(0, 0), (4, 0), (4, 3), (0, 3)}
    e = factor_maps.ellipses(df, "x", "y", "g").collect()
    assert len(e) == 1 and e[0].a >= e[0].b and factor_maps.ellipse_points(factor_maps.ellipses(df, "x", "y", "g")).count() == 73


SMOKERS = np.array([[4, 2, 3, 2], [4, 3, 7, 4], [25, 10, 12, 4], [18, 24, 33, 13], [10, 6, 7, 2]])


def test_correspondence_of_smokers(spark):
    c = correspondence.correspondence(SMOKERS)
    assert c.values == pytest.approx([0.074759, 0.010017, 0.000414], abs=1e-6) and c.chi2 == pytest.approx(16.4417, abs=1e-3) and c.df == 12
    assert c.values.sum() == pytest.approx(c.inertia) and np.allclose(c.row_mass @ c.row_coord, 0)
    profile_rows = SMOKERS / SMOKERS.sum(1, keepdims=True)
    assert np.allclose(profile_rows @ c.col_coord / np.sqrt(c.values), c.row_coord)  # transition
    t = c.points(spark).groupBy("side", "axis").agg(F.sum("contribution").alias("t")).toPandas()
    assert np.allclose(t["t"], 100) and c.cells(spark).agg(F.sum("contribution")).first()[0] == pytest.approx(100)
    long = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate((a, b) for a in range(5) for b in range(4) for _ in range(SMOKERS[a, b]))], "_row long, r string, c string")
    assert correspondence.correspondence_of(long, "r", "c").values == pytest.approx(c.values)
    m = correspondence.mca(long, ["r", "c"])
    want = sorted([(1 + s * v) / 2 for v in np.sqrt(c.values) for s in (1, -1)] + [0.5], reverse=True)
    assert m.core.k == 7 and m.core.values == pytest.approx(want, abs=1e-9) and m.raw_inertia == pytest.approx(9 / 2 - 1) and m.core.total == pytest.approx(3.5)
    with pytest.raises(ValueError, match="empty"):
        correspondence.correspondence(np.zeros((2, 2)))


def test_mca_rows_and_categories(spark, df):
    m = correspondence.mca(df, ["g", "s"], associations=True)
    f = coordinates(m.rows(df))
    assert np.allclose(f.mean(0), 0) and np.allclose((f**2).mean(0), m.core.values)
    # a category is the mean of its rows over the axis' root
    x = np.array([g == "x" for g in GROUP])
    j = m.levels.index("x")
    assert np.allclose(m.core.col_coord[j], f[x].mean(0) / np.sqrt(m.core.values))
    assert m.cramer.first().v > 0 and m.axes(spark).count() == 3 and m.categories(spark).groupBy("axis").agg(F.sum("contribution").alias("t")).where("abs(t - 100) > 1e-6").count() == 0


def test_famd_identities(spark, df, z):
    only = mixed.famd(df, NAMES, [])
    assert np.allclose(only.core.values, pca(z, NAMES).values)
    cats = mixed.famd(df, [], ["g", "s"])
    assert np.allclose(cats.core.values, 2 * correspondence.mca(df, ["g", "s"]).core.values)
    both = mixed.famd(df, NAMES[:3], ["g", "s"])
    f = coordinates(both.rows(df))
    assert both.core.total == pytest.approx(both.inertia) and np.allclose((f**2).mean(0), both.core.values)
    y = np.array([g == "y" for g in GROUP])
    assert np.allclose(both.barycentres[both.levels.index("y")], f[y].mean(0))
    for j in range(3):
        assert np.allclose(both.correlations[j], [np.corrcoef(DATA[:, j], f[:, k])[0, 1] for k in range(both.core.k)])
    assert (both.eta2 <= 1 + 1e-9).all() and np.allclose(both.correlations.__pow__(2).sum(0) + both.eta2.sum(0), both.core.values)
    with pytest.raises(ValueError, match="constant"):
        mixed.famd(df.withColumn("k", F.lit(1.0)), ["a", "k"], [])
    assert both.columns(spark).count() == (3 + 5) * both.core.k


def test_mfa_identities(spark, df, z):
    one = mixed.mfa(df, {"all": NAMES})
    values = pca(z, NAMES).values
    assert np.allclose(one.core.values, values / values[0])
    twice = mixed.mfa(df, {"x": NAMES, "y": NAMES})
    assert np.allclose(twice.core.values, 2 * one.core.values) and np.allclose(twice.rv, 1)
    m = mixed.mfa(df, {"q": ["a", "b"], "r": ["c", "d", "e"], "k": ["g", "s"]}, categorical=["k"])
    assert (m.group_inertia <= 1 + 1e-9).all() and np.allclose(np.diag(m.rv), 1) and ((m.rv >= 0) & (m.rv <= 1 + 1e-9)).all()
    f = coordinates(m.rows(df, 2))
    partial = m.partial(df, 2, keep=("_row",)).groupBy("_row").agg(F.avg("F1").alias("F1"), F.avg("F2").alias("F2"))
    assert np.allclose(coordinates(partial), f) and m.group_table(spark).count() == 3 * m.core.k
    for bad in ({}, {"x": []}):
        with pytest.raises(ValueError, match="group"):
            mixed.mfa(df, bad)


def test_core_projects_its_own_rows(df):
    g = gsvd.core(df, NAMES, [F.col(c) for c in NAMES])
    x = DATA - DATA.mean(0)
    u, d, v = np.linalg.svd(x / np.sqrt(N), full_matrices=False)
    assert np.allclose(g.values, d**2) and np.allclose(np.abs(coordinates(g.rows(df))), np.abs(x @ v.T))
    t = g.row_quality(df).toPandas()
    assert np.allclose(t.filter(like="contribution_").sum(0), 100) and np.allclose(t.filter(like="cos2_").sum(1), 1)


def test_description(df, z):
    rows = z.join(pca(z, NAMES).scores(z, 2, keep=["_row"]), "_row")
    r = describe.describe_numeric(rows, NAMES, ["F1", "F2"]).toPandas()
    assert r.groupby("axis").first()["r"].abs().min() > 0.7 and (r["p"] >= 0).all()
    v = describe.test_values(rows, "g", ["F1"]).toPandas()
    assert (v["n"] * v["mean"]).sum() == pytest.approx(0, abs=1e-9) and v["v"].abs().max() > 3
    t = describe.compare_groups(rows, "g", ["F1", "F2"]).toPandas().set_index("axis")
    assert t.loc["F1", "effect"] == "large" and t.loc["F1", "p"] < 1e-6
    assert describe.group_means(rows, "g", ["F1"]).where("low < mean and mean < high").count() == 3
    p = pca(z, NAMES)
    assert describe.residuals(p.correlation, p.loadings)["rmsr"] == pytest.approx(0, abs=1e-9) and describe.residuals(p.correlation, p.loadings[:, :1])["rmsr"] > 0.05
    assert describe.suggest_name(["u", "v", "w"], [0.9, -0.8, 0.1]) == "u vs v" and describe.effect_label(0.2, 0.5) == "none"
    c = describe.category_test_values(df, "s", "g").toPandas()
    assert len(c) == 6 and c["n_in"].sum() == N
    assert "holds 40.0 %" in describe.narrative([("F1", "u", 0.9)], [("x", 2.5)], 0.4)


def brute_ward(x, w):
    groups = [[i] for i in range(len(x))]
    heights = []
    while len(groups) > 1:
        best = None
        for i, j in itertools.combinations(range(len(groups)), 2):
            wi, wj = w[groups[i]].sum(), w[groups[j]].sum()
            ci, cj = np.average(x[groups[i]], axis=0, weights=w[groups[i]]), np.average(x[groups[j]], axis=0, weights=w[groups[j]])
            cost = wi * wj / (wi + wj) * ((ci - cj) ** 2).sum()
            if best is None or cost < best[0] - 1e-15:
                best = (cost, i, j)
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return heights


def test_ward_tree():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(25, 3)), rng.random(25)
    tree = cluster.ward(x, w / w.sum())
    assert np.allclose(tree.heights, brute_ward(x, w / w.sum())) and (np.diff(tree.heights) >= -1e-12).all() and len(tree.merges) == 24
    assert sorted(tree.leaf_order()) == list(range(25)) and tree.cut(25).tolist() == list(range(25)) and set(tree.cut(1)) == {0}
    g = tree.cut(4)
    within = sum(np.average(((x[g == c] - np.average(x[g == c], axis=0, weights=w[g == c])) ** 2).sum(1), weights=w[g == c]) * w[g == c].sum() for c in range(4)) / w.sum()
    assert within == pytest.approx(tree.heights[:21].sum()) and g[0] == 0
    with pytest.raises(ValueError, match="clusters"):
        tree.cut(26)


def test_silhouette_by_hand():
    x, g = np.array([[0.0], [1.0], [5.0], [7.0], [20.0]]), np.array([0, 0, 1, 1, 2])
    want = []
    for i in range(5):
        d = np.abs(x - x[i]).ravel()
        if (g == g[i]).sum() == 1:
            want.append(0)
            continue
        a = d[(g == g[i])].sum() / ((g == g[i]).sum() - 1)
        b = min(d[g == c].mean() for c in range(3) if c != g[i])
        want.append((b - a) / max(a, b))
    assert cluster.silhouette(x, g) == pytest.approx(np.mean(want)) and cluster.silhouette(x, np.zeros(5, int)) == 0


@pytest.mark.parametrize("most", [3000, 40])
def test_three_clusters_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(cluster, "MOST_POINTS", most)
    monkeypatch.setattr(cluster, "PROTOTYPES", 30)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.5, (20, 2)) for c in ((-6, -6), (6, -6), (0, 6))])
    rows = spark.createDataFrame([(i, float(a), float(b), "xyz"[i // 20]) for i, (a, b) in enumerate(x)], "_row long, F1 double, F2 double, k string")
    h = cluster.hcpc(rows, exact=None if most == 3000 else False)
    assert h.q == 3 and h.rules.agreed and h.exact == (most == 3000)
    assert h.rows.groupBy("k").agg(F.countDistinct("cluster").alias("n"), F.count("*").alias("m")).where("n != 1 or m != 20").count() == 0
    f = cluster.inertias(h.rows, h.axes)
    assert f["ratio"] > 0.95 and f["within"] + f["between"] == pytest.approx(f["total"])
    d = cluster.descriptors(h.rows, ["F1", "F2"], ["k"]).toPandas()
    assert (d["v"].abs() >= 1.96).all() and set(d["kind"]) == {"numeric", "category"}
    p = cluster.paragons(h.rows, h.axes, h.centres, 2).toPandas()
    assert len(p) == 12 and (p[p.place == 1].groupby(["cluster", "kind"]).size() == 1).all() and h.merges().count() == h.tree.n - 1
    assert h.tree.heights[-3] <= h.tree.cut_height(3) <= h.tree.heights[-2]


def test_recommender(spark, df):
    assert recommend.verdicts(4, 0)["pca"] == "recommended" and recommend.verdicts(0, 2)["ca"] == "recommended" and recommend.verdicts(0, 3)["mca"] == "recommended"
    assert recommend.verdicts(2, 3)["famd"] == "recommended" and recommend.verdicts(4, 1)["famd"] == "possible" and recommend.verdicts(1, 0)["pca"] == "not applicable"
    assert set(recommend.name_blocks(["soil_a", "soil_b", "soil_c", "leaf_a", "leaf_b", "x"])) == {"soil", "leaf"} and recommend.name_blocks(["a.b"] * 6) == {}
    a = recommend.recommend(df.drop("_row"), profile.profile(df.drop("_row")))
    assert a.pick == "pca" and ("ok", "correlation structure") in {w[:2] for w in a.warnings}
    assert recommend.rare_levels(spark.createDataFrame([("a",)] * 99 + [("b",)], "k string"), ["k"]).collect()[0].level == "b"


def test_every_method_runs(df):
    options = {"pca": {"numeric": NAMES}, "ca": {"categorical": ["g", "s"]}, "mca": {"categorical": ["g", "s"]}, "famd": {"numeric": NAMES[:2], "categorical": ["g"]}, "mfa": {"groups": {"x": ["a", "b"], "y": ["g", "s"]}}}
    for name, o in options.items():
        s = methods.run(df, name, **o)
        assert 1 <= s.k <= len(s.values) and (s.coordinates is None or s.coordinates.count() == N)
    for name, o in {"pca": {}, "ca": {"categorical": ["g", "g"]}, "mca": {}, "famd": {"numeric": ["a"]}, "mfa": {"groups": {"x": ["a"]}}, "no": {}}.items():
        with pytest.raises(ValueError, match="need|such"):
            methods.run(df, name, **o)
