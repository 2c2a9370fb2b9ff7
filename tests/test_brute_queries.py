"""Registered queries that SQL cannot express, against brute force over the same tables."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from multifactor.operators import rotation
from multifactor.plans import factors


@pytest.fixture(scope="module")
def read(sf_dir):
    return lambda name: pd.read_parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: factors.QUERIES[name](spark, sf_dir).toPandas()


@pytest.fixture(scope="module")
def embedded(read):
    e = read("embeddings")
    e = e[[v is not None and len(v) == 64 for v in e["embedding"]]]
    return e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float)


@pytest.fixture(scope="module")
def lines(read):
    li = read("lineitem")
    d = pd.DataFrame({"quantity": li["l_quantity"], "price": li["l_extendedprice"], "discounted": li["l_extendedprice"] * (1 - li["l_discount"])})
    d["charge"] = d["discounted"] * (1 + li["l_tax"])
    return d.assign(l_discount=li["l_discount"], l_tax=li["l_tax"], flag=li["l_returnflag"]).astype({c: float for c in d.columns})


def _axes(x):
    values, vectors = np.linalg.eigh(np.corrcoef(x, rowvar=False))
    return values[::-1], vectors[:, ::-1] * np.sqrt(np.maximum(values[::-1], 0))


def test_hulls_equal_gift_wrapping(run, read):
    orders, got = read("orders"), run("hulls_orders")
    for status, part in orders.groupby("o_orderstatus"):
        p = part[["o_totalprice", "o_custkey"]].astype(float).drop_duplicates().to_numpy()
        at, ring = p[np.lexsort((p[:, 1], p[:, 0]))[0]], []
        while not ring or (at != ring[0]).any():
            ring.append(at)
            far = p[0] if (p[0] != at).any() else p[1]
            for q in p:
                turn = (far[0] - at[0]) * (q[1] - at[1]) - (far[1] - at[1]) * (q[0] - at[0])
                if turn < 0 or (turn == 0 and ((q - at) ** 2).sum() > ((far - at) ** 2).sum()):
                    far = q
            at = far
        assert got[got["group"] == status].sort_values("place")[["x", "y"]].to_numpy().tolist() == [list(r) for r in ring]


def test_axes_and_partials_of_embeddings(run, embedded):
    _, x = embedded
    values, loadings = _axes(x)
    assert np.allclose(run("pca_axes_embeddings")["eigenvalue"], values, atol=1e-5)
    r, want = np.corrcoef(x, rowvar=False), []
    off = ~np.eye(64, dtype=bool)
    got = run("minimum_partial_embeddings").sort_values("m")
    for m in got["m"]:
        left = r - loadings[:, :m] @ loadings[:, :m].T
        c = left / np.sqrt(np.outer(np.diag(left), np.diag(left)))
        want.append((c[off] ** 2).mean())
    assert np.allclose(got["f"], want, atol=1e-6)


def test_partial_points_of_embeddings(run, embedded):
    ids, x = embedded
    z = (x - x.mean(0)) / x.std(0)
    weight = np.repeat([1 / np.linalg.eigvalsh(np.corrcoef(z[:, 16 * g : 16 * g + 16], rowvar=False))[-1] for g in range(4)], 16)
    values, vectors = np.linalg.eigh((z * np.sqrt(weight)).T @ (z * np.sqrt(weight)) / len(z))
    v = vectors[:, ::-1][:, :3]
    got = run("mfa_partial_embeddings")
    for g in range(4):
        at = slice(16 * g, 16 * g + 16)
        want = 4 * (z[:, at] * weight[at]) @ (v[at] / np.sqrt(weight[at])[:, None])
        mine = got[got["group"] == f"block{g}"].set_index("_row").loc[ids, ["F1", "F2", "F3"]].to_numpy()
        assert np.allclose(np.abs(mine), np.abs(want), atol=2e-3)


def _orthomax(a, gamma):
    return lambda loadings: float((loadings**4).sum() - gamma / len(a) * ((loadings**2).sum(0) ** 2).sum())


def _best(a, gamma, starts=12):
    """The greatest orthomax value over planar rotations by angle grids, from several starts."""
    rng, value, best = np.random.default_rng(0), _orthomax(a, gamma), -np.inf
    for _ in range(starts):
        x = a @ np.linalg.qr(rng.normal(size=(a.shape[1], a.shape[1])))[0]
        for _ in range(40):
            for i, j in itertools.combinations(range(a.shape[1]), 2):
                u, t = x[:, i] ** 2 - x[:, j] ** 2, 2 * x[:, i] * x[:, j]
                angle = math.atan2(2 * (u @ t) - 2 * gamma * u.sum() * t.sum() / len(a), u @ u - t @ t - gamma * (u.sum() ** 2 - t.sum() ** 2) / len(a)) / 4
                c, s = math.cos(angle), math.sin(angle)
                x[:, i], x[:, j] = c * x[:, i] + s * x[:, j], c * x[:, j] - s * x[:, i]
        best = max(best, value(x))
    return best


def test_varimax_of_embeddings_is_the_best_of_many_starts(run, embedded):
    _, loadings = _axes(embedded[1])
    a = loadings[:, :3]
    length = np.linalg.norm(a, axis=1, keepdims=True)
    got = run("rotated_loadings_embeddings").assign(v=lambda d: d["variable"].str[1:].astype(int)).pivot(index="v", columns="axis", values="pattern").to_numpy()
    assert _orthomax(a, 1)(got / length) == pytest.approx(_best(a / length, 1), rel=2e-3)


@pytest.mark.parametrize("method", ["varimax", "quartimax", "equamax", "parsimax"])
def test_orthogonal_rotations_of_three_axes_have_weights_of_their_own(lines, method):
    """With three axes of six measures the weights are 1, 0, 1.5 and 12/7."""
    x = lines[["quantity", "price", "discounted", "charge", "l_discount", "l_tax"]].to_numpy()
    a = _axes(x)[1][:, :3]
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    gamma = {"varimax": 1.0, "quartimax": 0.0, "equamax": 1.5, "parsimax": 12 / 7}[method]
    got = rotation.rotate(a, method).pattern / np.linalg.norm(a, axis=1, keepdims=True)
    assert _orthomax(unit, gamma)(got) == pytest.approx(_best(unit, gamma), rel=1e-6)


def test_oblique_axes_are_the_best_of_all_angles(run, lines):
    a = _axes(lines[["quantity", "price", "discounted", "charge", "l_discount"]].to_numpy())[1][:, :2]
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    at = np.linspace(0, np.pi, 721)[:-1]
    one, two = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
    ok = np.abs(np.sin(one - two)) > 0.05
    t = np.stack([np.stack([np.cos(one[ok]), np.cos(two[ok])], -1), np.stack([np.sin(one[ok]), np.sin(two[ok])], -1)], -2)
    loadings = unit[None] @ np.linalg.inv(t).transpose(0, 2, 1)
    value = (loadings[..., 0] ** 2 * loadings[..., 1] ** 2).sum(1)
    k = value.argmin()
    got = run("oblique_axes_lineitem")
    phi = got[(got["axis"] == 1) & (got["other"] == 2)]["r"].iloc[0]
    assert abs(phi) == pytest.approx(abs(math.cos(one[ok][k] - two[ok][k])), abs=0.02)
    for method in ("quartimin", "oblimin"):
        r = rotation.rotate(a, method)
        held = r.pattern / np.linalg.norm(a, axis=1, keepdims=True)
        assert (held[:, 0] ** 2 * held[:, 1] ** 2).sum() <= value[k] + 1e-6
        assert np.allclose(r.pattern @ r.phi @ r.pattern.T, a @ a.T, atol=1e-6)


def test_promax_equals_its_normal_equations(embedded, lines):
    for a in (_axes(embedded[1])[1][:, :4], _axes(lines.drop(columns="flag").to_numpy())[1][:, :3]):
        r = rotation.rotate(a, "promax")
        assert np.allclose(r.pattern @ r.phi @ r.pattern.T, a @ a.T, atol=1e-8) and np.allclose(np.diag(r.phi), 1)
        length = np.linalg.norm(a, axis=1, keepdims=True)
        x = rotation.rotate(a / length, "varimax", normalize=False).pattern
        u = np.linalg.inv(x.T @ x) @ x.T @ (x * np.abs(x) ** 3)
        u = u * np.sqrt(np.diag(np.linalg.inv(u.T @ u)))
        want = np.sort(np.abs(x @ u * length).sum(0))
        assert np.allclose(np.sort(np.abs(r.pattern).sum(0)), want, atol=1e-4)
    double = np.repeat(np.array([[0.5], [0.4], [0.3]]), 2, axis=1)  # of rank one: varimax is returned
    assert np.allclose(rotation.rotate(double, "promax").phi, np.eye(2))


def test_variances_of_all_rotations(run, embedded):
    _, loadings = _axes(embedded[1])
    values = (loadings**2).sum(0)
    for method, part in run("rotations_embeddings").groupby("method"):
        assert np.allclose(part.sort_values("axis")["before"], values[:4], atol=1e-3), method
        if method in ("none", "varimax", "quartimax", "equamax", "parsimax"):
            assert part["after"].sum() == pytest.approx(values[:4].sum(), abs=1e-3)


def _naive_ward(x):
    """Labels of every number of clusters, and heights: all pairs are looked at for each merge."""
    n = len(x)
    groups, heights, labels = [[i] for i in range(n)], [], {n: list(range(n))}
    while len(groups) > 1:
        m, w = np.array([x[g].mean(0) for g in groups]), np.array([len(g) / n for g in groups])
        cost = w[:, None] * w / (w[:, None] + w) * ((m[:, None] - m) ** 2).sum(2)
        np.fill_diagonal(cost, np.inf)
        i, j = divmod(int(cost.argmin()), len(groups))
        heights.append(cost[i, j])
        groups[min(i, j)] += groups.pop(max(i, j))
        mark = np.empty(n, int)
        for c, g in enumerate(sorted(groups, key=min)):
            mark[g] = c
        labels[len(groups)] = mark
    return labels, np.array(heights)


def _width(x, g):
    d, total = np.sqrt(((x[:, None] - x) ** 2).sum(2)), 0.0
    for i in range(len(x)):
        own = g == g[i]
        if own.sum() > 1:
            a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][g == c].mean() for c in set(g) - {g[i]})
            total += (b - a) / max(a, b)
    return total / len(x)


def test_clusters_and_paragons_of_customers(run, read):
    o = read("orders").groupby("o_custkey")["o_totalprice"].agg(["sum", "count"]).astype(float)
    z = ((o - o.mean()) / o.std()).to_numpy()
    r = np.corrcoef(z, rowvar=False)[0, 1]
    x = np.stack([z[:, 0] + np.sign(r) * z[:, 1], z[:, 0] - np.sign(r) * z[:, 1]], 1) / math.sqrt(2)
    labels, h = _naive_ward(x)
    up, down = {q: h[-q + 1] for q in range(2, 11)}, {q: h[-q] for q in range(2, 11)}
    votes = [max(up, key=lambda q: up[q] - down[q]), max(up, key=lambda q: (up[q] - down[q]) / down[q]), max(up, key=lambda q: _width(x, labels[q]))]
    q = min(votes, key=lambda v: (-Counter(votes)[v], v))
    g = labels[q]
    for _ in range(30):
        centres = np.array([x[g == c].mean(0) for c in range(q)])
        g = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    got = run("hcpc_customers").set_index("_row").loc[o.index]
    assert np.allclose(np.abs(got[["F1", "F2"]]), np.abs(x), atol=1e-4)
    pairs = set(zip(got["cluster"], g, strict=True))
    assert len(pairs) == q == got["cluster"].nunique()
    name = {b: a for a, b in pairs}
    d = np.sqrt(((x[:, None] - np.array([x[g == c].mean(0) for c in range(q)])) ** 2).sum(2))
    rows = run("cluster_paragons_customers")
    for c in range(q):
        mine = np.flatnonzero(g == c)
        near = sorted(mine, key=lambda i: d[i, c])[:5]
        odd = sorted(mine, key=lambda i: -min(d[i, e] for e in range(q) if e != c))[:5]
        for kind, want in (("paragon", near), ("specific", odd)):
            held = rows[(rows["cluster"] == name[c]) & (rows["kind"] == kind)].sort_values("place")
            assert held["_row"].tolist() == [o.index[i] for i in want]


def test_prototype_clusters_are_a_fixed_point(run, read, lines):
    li = read("lineitem")
    z = lines[["quantity", "price"]]
    z = ((z - z.mean()) / z.std()).to_numpy()
    x = np.stack([z[:, 0] + z[:, 1], z[:, 0] - z[:, 1]], 1) / math.sqrt(2)
    got = run("hcpc_lineitem_prototypes").set_index("_row")["cluster"].loc[li["l_orderkey"] * 10 + li["l_linenumber"]].to_numpy()
    assert len(got) == len(x) and set(got) == {0, 1, 2, 3}
    centres = np.array([x[got == c].mean(0) for c in range(4)])
    assert (((x[:, None] - centres) ** 2).sum(2).argmin(1) == got).mean() > 0.995  # the means of the last round


def test_methods_on_lineitem(run, lines):
    got = run("method_runs_lineitem").set_index("method")
    r = lambda a, b: abs(np.corrcoef(lines[a], lines[b])[0, 1])
    q = np.where(lines["quantity"] > 25, "many", "few")
    table = pd.crosstab(q, lines["flag"]).to_numpy(float)
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    mfa = 2 / (1 + r("quantity", "price")) + 2 / (1 + r("l_discount", "l_tax"))
    want = {"pca": (3, 3.0), "ca": (1, ((table - e) ** 2 / e).sum() / table.sum()), "mca": (4, 7 / 3 - 1), "famd": (2, 2.0), "mfa": (4, mfa)}
    for method, (axes, inertia) in want.items():
        assert got.loc[method, "axes"] == axes and got.loc[method, "inertia"] == pytest.approx(inertia, abs=2e-6) and 1 <= got.loc[method, "kept"] <= axes


def test_consensus_is_the_number_with_most_weight(run):
    rules = run("all_criteria_lineitem")
    votes = rules[rules["name"] != "consensus"].groupby("k")["weight"].sum()
    assert len(rules) == 9 and rules[rules["name"] == "consensus"].iloc[0].tolist() == ["consensus", min(votes.index, key=lambda k: (-votes[k], k)), votes.sum()]


def test_random_bars_equal_those_of_drawn_rows(run, lines):
    rng, n = np.random.default_rng(1), len(lines)
    drawn = np.array([np.linalg.eigvalsh(np.corrcoef(rng.normal(size=(n, 4)), rowvar=False))[::-1] for _ in range(300)])
    got = run("parallel_analysis_lineitem").sort_values("axis")
    assert np.allclose(got["eigenvalue"], _axes(lines[["quantity", "price", "discounted", "charge"]].to_numpy())[0], atol=1e-4)
    assert np.allclose(got["mean"], drawn.mean(0), atol=0.004) and np.allclose(got["p95"], np.percentile(drawn, 95, axis=0), atol=0.012)
    assert (got["kept"] == (got["eigenvalue"] > got["p95"])).all()
    x = lines[["quantity", "price", "discounted"]].to_numpy()
    moved = np.array([np.linalg.eigvalsh(np.corrcoef(np.stack([rng.permutation(c) for c in x.T]), rowvar=True))[::-1] for _ in range(300)])
    got = run("parallel_permuted_lineitem").sort_values("axis")
    assert np.allclose(got["mean"], moved.mean(0), atol=0.012) and np.allclose(got["p95"], np.percentile(moved, 95, axis=0), atol=0.03)


def test_warnings_and_picks(run, read):
    got = run("method_warnings")
    for name, columns in factors._SUITED.items():
        t, mine = read(name)[columns], got[got["table"] == name]
        numeric = [c for c in columns if pd.api.types.is_numeric_dtype(t[c])]
        row = mine[mine["title"].isin(["no correlation to summarise", "correlation structure"])]
        if len(numeric) < 2:
            assert row.empty
            continue
        r = t[numeric].astype(float).corr().to_numpy()
        sizes = np.abs(r[np.triu_indices(len(r), 1)])
        assert row.iloc[0]["figures"].startswith(f"mean |r| = {sizes.mean():.3f}")
        p, n = len(r), len(t)
        chi2, df = -((n - 1) - (2 * p + 5) / 6) * math.log(np.linalg.det(r)), p * (p - 1) // 2
        tail = math.erfc(math.sqrt(chi2 / 2)) if df == 1 else math.exp(-chi2 / 2) * sum((chi2 / 2) ** k / math.factorial(k) for k in range(df // 2))
        assert df in (1, 6)
        none = tail >= 0.05 or (sizes.mean() < 0.2 and (sizes >= 0.3).sum() <= 1)
        assert row.iloc[0]["level"] == ("bad" if none else "ok") and (not none or row.iloc[0]["figures"].endswith(f"p = {tail:.3g}"))
    assert dict(zip(got["table"], got["pick"], strict=True)).items() >= {"orders": "ca", "lineitem": "pca"}.items()
