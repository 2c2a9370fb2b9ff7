"""Hierarchical clustering on factor coordinates: Ward's tree, cutting rules, consolidation and description.

Up to ``MOST_POINTS`` rows the tree is built at once; beyond, Spark merges mutual neighbours until so many clusters are
left (``hierarchy``), which gives the same tree. Beyond ``EXACT_ROWS`` rows, unless the exact tree is asked for, it is built on
weighted prototypes of all rows and so is approximate. Consolidation runs over all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from multifactor.functions import distributions as D
from multifactor.functions.columns import col
from multifactor.operators.describe import category_test_values, test_value
from multifactor.operators.hierarchy import Forest, silhouettes, ward_forest

MOST_POINTS, EXACT_ROWS = 3000, 20_000
PROTOTYPES = 300
MOST_EXPRESSIONS = 16


@dataclass(frozen=True)
class Tree:
    """Merges (a, b) of nodes 0..n-1 (points) and n.. (earlier merges), with their heights in order."""

    n: int
    merges: np.ndarray
    heights: np.ndarray
    sizes: np.ndarray

    def cut(self, q: int) -> np.ndarray:
        """Cluster of each point when the last q - 1 merges are undone, numbered by smallest member."""
        if not 1 <= q <= self.n:
            raise ValueError(f"a number of clusters from 1 to {self.n} is needed")
        label = np.arange(2 * self.n - 1)
        for i in range(self.n - q):
            label[self.n + i] = -1
        parent = np.arange(2 * self.n - 1)
        for i in range(self.n - q):
            parent[self.merges[i]] = self.n + i
        for i in range(2 * self.n - 2, -1, -1):
            parent[i] = parent[parent[i]]
        roots = parent[: self.n]
        order: dict[int, int] = {}
        return np.array([order.setdefault(int(r), len(order)) for r in roots])

    def leaf_order(self) -> list[int]:
        """Leaves from left to right, the lower of two children first."""
        height = np.concatenate([np.zeros(self.n), self.heights])
        stack, out = [2 * self.n - 2], []
        while stack:
            node = stack.pop()
            if node < self.n:
                out.append(int(node))
            else:
                a, b = sorted(self.merges[node - self.n].tolist(), key=lambda x: (height[x], x))
                stack += [b, a]
        return out

    def cut_height(self, q: int) -> float:
        """Midway between the merges around q clusters."""
        upper = self.heights[self.n - q] if q > 1 else self.heights[-1] * 1.05
        lower = self.heights[self.n - q - 1] if q < self.n else 0.0
        return float((upper + lower) / 2)


def ward(points: np.ndarray, weights: np.ndarray | None = None) -> Tree:
    """Ward's tree of weighted points: a merge costs wa wb / (wa + wb) times the squared distance of the centres.

    Nearest neighbours are kept for each node; of equal costs the lowest nodes merge.
    """
    x = np.asarray(points, float).copy()
    n = len(x)
    w = np.full(n, 1 / max(1, n)) if weights is None else np.asarray(weights, float).copy()
    node, alive = np.arange(n), np.ones(n, bool)
    size = np.ones(n, int)

    def costs(i: int) -> np.ndarray:
        c = w[i] * w / (w[i] + w) * ((x - x[i]) ** 2).sum(1)
        c[~alive] = np.inf
        c[i] = np.inf
        return c

    cost = np.array([costs(i) for i in range(n)]) if n else np.zeros((0, 0))
    near = cost.argmin(1) if n > 1 else np.zeros(n, int)
    least = cost[np.arange(n), near] if n > 1 else np.full(n, np.inf)
    merges, heights, sizes = [], [], []
    for step in range(n - 1):
        i = int(np.argmin(np.where(alive, least, np.inf)))
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        merges.append(sorted((int(node[i]), int(node[j]))))
        heights.append(float(cost[i, j]))
        total = w[i] + w[j]
        x[i] = (w[i] * x[i] + w[j] * x[j]) / total
        w[i], alive[j], node[i] = total, False, n + step
        size[i] += size[j]
        sizes.append(int(size[i]))
        cost[j], cost[:, j] = np.inf, np.inf
        new = costs(i)
        cost[i], cost[:, i] = new, new
        stale = alive & ((near == i) | (near == j) | (new < least))
        stale[i] = True
        for k in np.flatnonzero(stale):
            near[k] = int(np.argmin(cost[k]))
            least[k] = cost[k, near[k]]
    return Tree(n, np.array(merges, int).reshape(-1, 2), np.array(heights), np.array(sizes, int))


def silhouette(points: np.ndarray, cluster: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Mean Euclidean silhouette of all points; clusters of one point count 0. Weighted points stand for their weight."""
    x, g = np.asarray(points, float), np.asarray(cluster)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float) / np.mean(weights)
    q = int(g.max()) + 1 if len(g) else 0
    if q < 2:
        return 0.0
    member = np.zeros((len(x), q))
    member[np.arange(len(x)), g] = w
    mass, count = member.sum(0), np.bincount(g, minlength=q)
    total = 0.0
    for a in range(0, len(x), 512):
        d = np.sqrt(np.maximum(((x[a : a + 512, None, :] - x[None, :, :]) ** 2).sum(2), 0))
        sums = d @ member
        rows = np.arange(len(d))
        own = g[a : a + 512]
        inner = sums[rows, own] / np.maximum(mass[own] - w[a : a + 512], 1e-12)
        means = np.where(mass > 0, sums / np.maximum(mass, 1e-300), np.inf)
        means[rows, own] = np.inf
        outer = means.min(1)
        s = np.where(count[own] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
        total += float((s * w[a : a + 512]).sum())
    return total / float(w.sum())


@dataclass(frozen=True)
class CutRules:
    """Number of clusters by each rule, and the rules' consensus."""

    jump: int
    relative: int
    silhouette: int
    consensus: int
    silhouettes: list[tuple[int, float]]

    @property
    def agreed(self) -> bool:
        return self.jump == self.relative == self.silhouette


def cut_rules(points: np.ndarray, tree: Tree, most: int = 10, weights: np.ndarray | None = None, *, widths: Callable[[list[int]], list[float]] | None = None, relative_decides: bool = False) -> CutRules:
    """Largest height jump, largest relative jump and best silhouette over 2..most clusters; the first of equals each.

    Where all three differ the smallest wins, or with ``relative_decides`` the relative rule. ``widths`` gives silhouettes
    for several numbers of clusters where the points are not all rows.
    """
    most = max(2, min(most, tree.n - 1))
    up = {q: tree.heights[-q + 1] for q in range(2, most + 1)}
    down = {q: tree.heights[-q] if q <= len(tree.heights) else 0.0 for q in range(2, most + 1)}
    jump = max(up, key=lambda q: (up[q] - down[q], -q))
    relative = max(up, key=lambda q: ((up[q] - down[q]) / down[q] if down[q] > 0 else 0.0, -q))
    measured = list(zip(up, widths(list(up)) if widths else [silhouette(points, tree.cut(q), weights) for q in up], strict=True))
    best = max(measured, key=lambda s: (s[1], -s[0]))[0]
    votes = Counter([jump, relative, best])
    agreed = min(votes, key=lambda q: (-votes[q], q))
    if relative_decides and len(votes) == 3:
        agreed = relative
    return CutRules(jump, relative, best, agreed, measured)


def _distances(axes: Sequence[str], centres: np.ndarray) -> list[Column]:
    out = []
    for c in centres:
        total = F.lit(0.0)
        for a, v in zip(axes, c, strict=True):
            total = total + F.pow(col(a) - F.lit(float(v)), 2)
        out.append(total)
    return out


def nearest_centres(x: Sequence[np.ndarray], centres: np.ndarray, together: int = 512) -> np.ndarray:
    """Number of the nearest centre (the lowest of equals) of points given axis by axis, summed in blocks that stay in cache."""
    n = len(x[0])
    out, total, part = np.zeros(n, np.int32), np.empty((together, len(centres))), np.empty((together, len(centres)))
    for s in range(0, n, together):
        m = min(together, n - s)
        for k, a in enumerate(x):
            to = part[:m] if k else total[:m]
            np.subtract(a[s : s + m, None], centres[:, k], out=to)
            np.square(to, out=to)
            if k:
                np.add(total[:m], to, out=total[:m])
        out[s : s + m] = total[:m].argmin(1)
    return out


def assigned(rows: DataFrame, axes: Sequence[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """``rows`` with the nearest centre's number, the lowest of equals; one projection, no shuffle."""
    if len(centres) == 1:
        return rows.withColumn(name, F.lit(0))
    if len(centres) > MOST_EXPRESSIONS:  # too many expressions to compile: blocks of numpy

        @F.pandas_udf(T.IntegerType())
        def nearest(*coordinates: pd.Series) -> pd.Series:
            return pd.Series(nearest_centres([c.to_numpy(float) for c in coordinates], centres))

        return rows.withColumn(name, nearest(*[col(a).cast("double") for a in axes]))
    held = F.array(*_distances(axes, centres))
    return rows.withColumn(name, (F.array_position(held, F.array_min(held)) - 1).cast("int"))


def centres_of(rows: DataFrame, axes: Sequence[str], cluster: str = "cluster") -> pd.DataFrame:
    """Size and mean of each cluster, by number."""
    return rows.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(col(a)).alias(a) for a in axes]).toPandas().sort_values(cluster)


def consolidate(rows: DataFrame, axes: Sequence[str], centres: np.ndarray, iterations: int = 30) -> tuple[np.ndarray, int]:
    """k-means from given centres: each round one distributed assignment and aggregation. Empty clusters go."""
    for i in range(iterations):
        found = centres_of(assigned(rows, axes, centres), axes)
        new = found[list(axes)].to_numpy(float)
        if new.shape == centres.shape and np.allclose(new, centres, rtol=0, atol=1e-12):
            return new, i + 1
        centres = new
    return centres, iterations


def inertias(rows: DataFrame, axes: Sequence[str], cluster: str = "cluster") -> dict[str, float]:
    """Within, between and total inertia (weights 1/n) of a partition, in one grouped aggregation."""
    g = rows.groupBy(col(cluster).alias("g")).agg(F.count("*").alias("n"), *[f.alias(f"{k}{i}") for i, a in enumerate(axes) for k, f in (("m", F.avg(col(a))), ("v", F.var_pop(col(a))))]).toPandas()
    n = g["n"].to_numpy(float)
    m, v = g[[f"m{i}" for i in range(len(axes))]].to_numpy(float), g[[f"v{i}" for i in range(len(axes))]].to_numpy(float)
    share = n / n.sum()
    grand = share @ m
    within, between = float((share[:, None] * v).sum()), float((share[:, None] * (m - grand) ** 2).sum())
    return {"within": within, "between": between, "total": within + between, "ratio": between / (within + between) if within + between > 0 else 0.0}


def cluster_test_values(rows: DataFrame, measures: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, measure, n, mean, overall, v, p) of each measure in each cluster."""
    overall = rows.agg(F.count("*").alias("N"), *[f.alias(f"{k}{i}") for i, m in enumerate(measures) for k, f in (("m", F.avg(col(m))), ("s", F.var_pop(col(m))))]).first()
    g = rows.groupBy(col(cluster).alias("cluster")).agg(F.count("*").alias("n"), *[F.avg(col(m)).alias(f"g{i}") for i, m in enumerate(measures)])
    x = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"g{i}").alias("mean"), F.lit(overall[f"m{i}"]).alias("overall"), F.lit(overall[f"s{i}"]).alias("s")) for i, m in enumerate(measures)]))
    long = g.select("cluster", "n", x.alias("x")).select("cluster", "n", "x.*")
    return long.select("cluster", "measure", "n", "mean", "overall", test_value(F.col("mean"), F.col("overall"), F.col("s"), F.col("n"), F.lit(overall.N)).alias("v")).withColumn("p", D.normal_two_sided_column("v"))


def descriptors(rows: DataFrame, measures: Sequence[str], categories: Sequence[str], cluster: str = "cluster", least: float = 1.96) -> DataFrame:
    """(kind, cluster, name, v, p): what marks each cluster, |v| of ``least`` or more, strongest first."""
    out = cluster_test_values(rows, measures, cluster).select(F.lit("numeric").alias("kind"), "cluster", F.col("measure").alias("name"), "v", "p")
    for c in categories:
        out = out.unionByName(category_test_values(rows, c, cluster).select(F.lit("category").alias("kind"), "cluster", F.concat(F.lit(f"{c}="), "level").alias("name"), "v", "p"))
    return out.where(F.abs("v") >= least).orderBy("cluster", F.desc(F.abs("v")), "name")


def paragons(rows: DataFrame, axes: Sequence[str], centres: np.ndarray, n: int = 5, cluster: str = "cluster", key: str = "_row") -> DataFrame:
    """(cluster, kind, place, _row, distance): the n rows nearest their centre, and the n farthest from all other centres.

    Each task keeps its n best rows of each cluster before they meet, so no cluster is gathered.
    """
    held = rows.select(col(cluster).alias("_g"), col(key).alias("_key"), F.array(*_distances(axes, centres)).alias("_d"))
    near = held.select("_g", "_key", F.sqrt(F.element_at("_d", F.col("_g") + 1)).alias("_own"), F.sqrt(F.array_min(F.filter("_d", lambda x, i: i != F.col("_g")))).alias("_other"))
    pair = F.array(F.struct(F.lit("paragon").alias("kind"), F.col("_own").alias("distance"), F.col("_own").alias("by")), F.struct(F.lit("specific").alias("kind"), F.col("_other").alias("distance"), (-F.col("_other")).alias("by")))
    slim = near.select(F.col("_g").alias("cluster"), F.col("_key").alias("_row"), F.explode(pair).alias("x")).select("cluster", "_row", "x.*").where("distance is not null")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch])
            held = both.sort_values(["by", "_row"]).groupby(["cluster", "kind"], sort=False).head(n)
        if held is not None:
            yield held

    place = F.row_number().over(W.partitionBy("cluster", "kind").orderBy("by", "_row"))
    top = slim.mapInPandas(best, slim.schema)
    return top.withColumn("place", place).where(F.col("place") <= n).select("cluster", "kind", "place", "_row", "distance")


@dataclass(frozen=True)
class Hcpc:
    """A clustering: ``rows`` with ``cluster``, centres (q x axes), the tree, the rules, and whether the tree is exact."""

    rows: DataFrame
    axes: list[str]
    centres: np.ndarray
    tree: Tree
    rules: CutRules
    exact: bool
    iterations: int

    @property
    def q(self) -> int:
        return len(self.centres)

    def merges(self) -> DataFrame:
        """(step, a, b, height, size) of the tree."""
        out = [(i + 1, int(a), int(b), float(h), int(s)) for i, ((a, b), h, s) in enumerate(zip(self.tree.merges, self.tree.heights, self.tree.sizes, strict=True))]
        return self.rows.sparkSession.createDataFrame(out, "step int, a int, b int, height double, size int")


def _prototypes(rows: DataFrame, axes: Sequence[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted prototypes: k-means rounds over all rows from those with the least seeded hash of ``_key``."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "_key")).limit(PROTOTYPES).select(*[col(a) for a in axes]).toPandas().drop_duplicates().to_numpy(float)
    centres, _ = consolidate(rows, axes, sample, 5)
    found = centres_of(assigned(rows, axes, centres), axes)
    return found[list(axes)].to_numpy(float), found["n"].to_numpy(float) / n


@dataclass(frozen=True)
class Crown:
    """The upper part of a forest's tree: the tree over its leaves, which are clusters (ids, points, weights) in order of id."""

    tree: Tree
    ids: np.ndarray
    points: np.ndarray
    weights: np.ndarray
    undone: list[int]


def crown(forest: Forest, depth: int) -> Crown:
    """The tree over a forest's clusters, and below them of what the ``depth`` highest merges of all divide.

    Mutual neighbours may merge early at a great height. Those of the forest's merges that are among the highest are
    undone; every merge above one of them is higher and so among them too.
    """
    left = forest.clusters
    leaf = {int(r.id): (float(r.w), int(r.n), np.asarray(r.x, float)) for r in left.itertuples()}
    upper = ward(np.stack(left["x"].to_numpy()), left["w"].to_numpy(float))
    lower = forest.merges.orderBy(F.desc("height"), F.desc("step")).limit(depth).collect()
    heights = sorted([*upper.heights.tolist(), *[m.height for m in lower]], reverse=True)
    bar = heights[min(depth, len(heights)) - 1] if heights else np.inf
    undone = sorted((m for m in lower if m.height >= bar), key=lambda m: -m.step)
    for m in undone:
        leaf[m.keep], leaf[m.gone] = (m.w_k, m.n_k, np.asarray(m.x_k)), (m.w_g, m.n_g, np.asarray(m.x_g))
    named, joined = left["id"].tolist(), [(m.height, m.step, m.keep, m.gone) for m in undone]
    for i, ((a, b), h) in enumerate(zip(upper.merges.tolist(), upper.heights.tolist(), strict=True)):
        joined.append((h, forest.steps + i, *sorted((named[a], named[b]))))
        named.append(min(named[a], named[b]))
    ids = sorted(leaf)
    node, size = {c: i for i, c in enumerate(ids)}, {c: leaf[c][1] for c in ids}
    merges, sizes = [], []
    for i, (_, _, keep, gone) in enumerate(sorted(joined)):
        merges.append(sorted((node[keep], node[gone])))
        size[keep] += size[gone]
        sizes.append(size[keep])
        node[keep] = len(ids) + i
    tree = Tree(len(ids), np.array(merges, int).reshape(-1, 2), np.array([j[0] for j in sorted(joined)]), np.array(sizes, int))
    return Crown(tree, np.array(ids), np.stack([leaf[c][2] for c in ids]), np.array([leaf[c][0] for c in ids]), [m.gone for m in undone])


def crown_rows(forest: Forest, top: Crown, counts: Sequence[int]) -> DataFrame:
    """(id, x, g0, g1, ...): every row's point and its cluster when the tree is cut into each of ``counts``."""
    spark = forest.points.sparkSession
    cuts = [top.tree.cut(q) for q in counts]
    labels = spark.createDataFrame([(int(c), *[int(g[i]) for g in cuts]) for i, c in enumerate(top.ids)], "cluster long, " + ", ".join(f"g{i} int" for i in range(len(counts))))
    undone = spark.createDataFrame([(int(g),) for g in top.undone], "gone long")
    known = forest.members(undone).join(F.broadcast(labels), "cluster").drop("cluster")  # as many as the crown has leaves
    return forest.points.join(known, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("copy", "n")


def hcpc(rows: DataFrame, axes: Sequence[str] | None = None, q: int | None = None, *, most: int = 10, consolidated: bool = True, seed: int = 42, exact: bool | None = None) -> Hcpc:
    """Cluster rows on their coordinates (five axes at most by default), into q clusters or as the rules agree.

    ``exact`` asks for Ward's tree of all rows, or for that of prototypes; by default rows up to EXACT_ROWS get the first.
    """
    axes = list(axes or [c for c in rows.columns if c.startswith("F") and c[1:].isdigit()][:5])
    key = col("_row") if "_row" in rows.columns and dict(rows.dtypes)["_row"] in ("bigint", "int") else F.monotonically_increasing_id()
    slim = rows.select(*[col(a) for a in axes], key.alias("_key")).persist(StorageLevel.MEMORY_AND_DISK)  # every round reads it again
    head = slim.select("_key", *[col(a) for a in axes]).limit(MOST_POINTS + 1).toPandas()
    head = head.sort_values("_key", kind="stable")[axes].to_numpy(float)  # the order decides ties only
    weights = widths = None
    if len(head) <= MOST_POINTS:
        points, exact = head, True
        tree = ward(points)
    elif exact or (exact is None and slim.count() <= EXACT_ROWS):
        forest, exact = ward_forest(slim, axes, "_key", MOST_POINTS), True
        top = crown(forest, max(most, q or 0) + 1)
        points, weights, tree = top.points, top.weights, top.tree

        def widths(counts: list[int]) -> list[float]:
            labelled = crown_rows(forest, top, counts).select(*[F.element_at("x", i + 1).alias(f"x{i}") for i in range(len(axes))], *[f"g{i}" for i in range(len(counts))])
            return silhouettes(labelled, [f"x{i}" for i in range(len(axes))], [f"g{i}" for i in range(len(counts))])
    else:
        (points, weights), exact = _prototypes(slim, axes, seed), False
        tree = ward(points, weights)
    rules = cut_rules(points, tree, most, weights, widths=widths)
    g = tree.cut(q or rules.consensus)
    w = np.ones(len(points)) if weights is None else weights
    centres = np.array([np.average(points[g == c], axis=0, weights=w[g == c]) for c in range(g.max() + 1)])
    rounds = 0
    if consolidated:
        centres, rounds = consolidate(slim, axes, centres)
    slim.unpersist()
    return Hcpc(assigned(rows, axes, centres), axes, centres, tree, rules, exact, rounds)
