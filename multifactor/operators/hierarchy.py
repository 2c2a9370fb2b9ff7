"""Ward's tree and silhouettes of rows that stay in Spark: exact, by rounds over cells of near points."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.functions.columns import col
from multifactor.operators.storage import stored

#: Points of a cell, in which neighbours are looked for, and rows of a cell of silhouettes, about.
CELL_POINTS, CELL_ROWS = 2000, 4096


def _place(x: Column, low: np.ndarray, high: np.ndarray) -> Column:
    """A point's place on a curve through the box (bits of at most three axes in turn): near places are near points."""
    axes = min(3, len(low))
    span = np.where(high > low, high - low, 1.0)

    @F.pandas_udf(T.LongType())
    def place(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype="int64")
        part = ((np.stack(points.to_numpy()) - low) / span * ((1 << 20) - 1)).clip(0, (1 << 20) - 1).astype(np.int64)
        out = np.zeros(len(part), np.int64)
        for bit in range(20):
            for a in range(axes):
                out |= ((part[:, a] >> bit) & 1) << (bit * axes + a)
        return pd.Series(out)

    return place(x)


def _box(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    r = rows.agg(*[f(F.element_at("x", a + 1)) for f in (F.min, F.max) for a in range(p)]).first()
    return np.array(r[:p], float), np.array(r[p:], float)


def _celled(rows: DataFrame, box: tuple[np.ndarray, np.ndarray], cells: int) -> DataFrame:
    """``rows`` (with ``x``) stored with ``cell``: ranges of places, of about equal numbers of rows."""
    low, high = box
    return stored(rows.repartitionByRange(max(1, cells), _place(F.col("x"), low, high)).withColumn("cell", F.spark_partition_id()))


def _costs(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """What merging each of a with each of b costs; equal to the bit from both sides."""
    d2 = np.zeros((len(xa), len(xb)))
    for k in range(xa.shape[1]):
        d2 += (xa[:, k, None] - xb[None, :, k]) ** 2
    return wa[:, None] * wb[None, :] / (wa[:, None] + wb[None, :]) * d2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cheapest(cost: np.ndarray, mine: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, cost, turn) of each row's least cost; of equal costs the pair with the least hash, the same from both sides."""
    j = cost.argmin(1)
    least = cost[np.arange(len(cost)), j]
    turn = lambda i, at: (_mixed(_mixed(mine[i].astype(np.uint64)) ^ _mixed(ids[at].astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
    best = turn(np.arange(len(cost)), j)
    for a in np.flatnonzero((cost == least[:, None]).sum(1) > 1):
        at = np.flatnonzero(cost[a] == least[a])
        turns = turn(np.full(len(at), a), at)
        k = turns.argmin()
        j[a], best[a] = at[k], turns[k]
    return j, least, best


def nearest(points: DataFrame, box: tuple[np.ndarray, np.ndarray], count: int, cell_points: int = CELL_POINTS) -> DataFrame:
    """(id, partner, cost): for each weighted point (id, w, x) the one that it merges with at the least cost.

    Of equal costs the pair with the least hash counts: evenly spaced points find as many mutual neighbours as others do.

    Each cell finds neighbours among its own points. Another cell can hold a cheaper one only if its box and its least
    weight allow a lower cost; a point goes to those cells, and there it is held against all points.
    """
    p = len(box[0])
    celled = _celled(points.select("id", "w", "x"), box, -(-count // cell_points))
    stats = celled.groupBy("cell").agg(F.min("w").alias("w"), *[f(F.element_at("x", a + 1)).alias(f"{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in range(p)]).toPandas()
    cells, least = stats["cell"].to_numpy(int), stats["w"].to_numpy(float)
    low, high = (stats[[f"{n}{a}" for a in range(p)]].to_numpy(float) for n in "lh")

    def bound(x: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The least that each point's merge with a point of each cell can cost."""
        d2 = np.zeros((len(x), len(at)))
        for k in range(p):
            d2 += np.maximum(np.maximum(low[None, at, k] - x[:, k, None], x[:, k, None] - high[None, at, k]), 0.0) ** 2
        return w[:, None] * least[None, at] / (w[:, None] + least[None, at]) * d2 * (1 - 1e-12)

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        x, w, ids = np.stack(rows["x"].to_numpy()), rows["w"].to_numpy(float), rows["id"].to_numpy()
        cost, partner, turn = np.full(len(x), np.inf), np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x) if len(x) > 1 else 0, 512):
            part = slice(a, a + 512)
            c = _costs(x[part], w[part], x, w)
            c[np.arange(len(c)), np.arange(a, a + len(c))] = np.inf
            j, cost[part], turn[part] = _cheapest(c, ids[part], ids)
            partner[part] = ids[j]
        own = int(rows["cell"].iloc[0])
        # first cells that are too far for any of these points, then cells by point
        mine = int(np.flatnonzero(cells == own)[0])
        gap = np.maximum(np.maximum(low - high[mine], low[mine] - high), 0.0)
        reach = w.min() * least / (w.min() + least) * (gap**2).sum(1) * (1 - 1e-12)
        near = np.flatnonzero((reach <= cost.max()) & (cells != own))
        more = [[] for _ in range(len(x))]
        for a in range(0, len(near), 256):
            at = near[a : a + 256]
            for i, c in zip(*np.nonzero(bound(x, w, at) <= cost[:, None]), strict=True):
                more[i].append(int(cells[at[c]]))
        return pd.DataFrame({"id": ids, "w": w, "x": rows["x"], "partner": partner, "cost": cost, "turn": turn, "more": more})

    def across(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"id": [], "partner": [], "cost": [], "turn": []})
        held = held.sort_values("id", kind="stable")
        x, w, ids = np.stack(held["x"].to_numpy()), held["w"].to_numpy(float), held["id"].to_numpy()
        xa, wa = np.stack(asked["x"].to_numpy()), asked["w"].to_numpy(float)
        cost, partner, turn, mine = np.empty(len(xa)), np.empty(len(xa), np.int64), np.empty(len(xa), np.int64), asked["id"].to_numpy()
        for a in range(0, len(xa), 512):
            part = slice(a, a + 512)
            j, cost[part], turn[part] = _cheapest(_costs(xa[part], wa[part], x, w), mine[part], ids)
            partner[part] = ids[j]
        return pd.DataFrame({"id": mine, "partner": partner, "cost": cost, "turn": turn})

    first = stored(celled.groupBy("cell").applyInPandas(inside, "id long, w double, x array<double>, partner long, cost double, turn long, more array<int>"))
    asked = first.where("size(more) > 0").select(F.explode("more").alias("cell"), "id", "w", "x")
    second = asked.groupBy("cell").cogroup(celled.groupBy("cell")).applyInPandas(across, "id long, partner long, cost double, turn long")
    best = first.where("partner >= 0").select("id", "partner", "cost", "turn").unionByName(second).groupBy("id").agg(F.min(F.struct("cost", "turn", "partner")).alias("m"))
    return best.select("id", "m.partner", "m.cost")


@dataclass(frozen=True)
class Forest:
    """Ward's tree up to a number of clusters that fit the driver, and those clusters.

    ``points`` (id, n, x) are the distinct rows; ``merges`` (step, keep, gone, height, and w, n, x of both before) join two
    clusters, named by their least point; ``clusters`` (id, w, n, x) are what is left.
    """

    points: DataFrame
    merges: DataFrame
    clusters: pd.DataFrame
    steps: int

    def members(self, undone: DataFrame | None = None) -> DataFrame:
        """(id, cluster): each point's cluster where all merges count but those of ``undone`` (gone)."""
        links = self.merges.select(F.col("gone").alias("id"), F.col("keep").alias("cluster"))
        links = links if undone is None else links.join(undone.select(F.col("gone").alias("id")), "id", "left_anti")
        for _ in range(max(1, self.steps).bit_length()):  # a chain of links is at most as long as there were rounds
            up = links.select(F.col("id").alias("cluster"), F.col("cluster").alias("up"))
            links = stored(links.join(up, "cluster", "left").select("id", F.coalesce("up", "cluster").alias("cluster")))
        return self.points.select("id").join(links, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def ward_forest(rows: DataFrame, axes: Sequence[str], key: str, most: int, cell_points: int = CELL_POINTS) -> Forest:
    """Merge rows by Ward's criterion until at most ``most`` clusters are left.

    Ward's cost never falls by a merge of others, so two clusters that are each other's cheapest partner merge in every
    order: each round merges all such pairs at once, about a third of the clusters, and the tree is that of merging one pair at
    a time. Equal rows are one weighted point from the start. Among equal costs the order is that of a hash, so trees may differ there.
    """
    p = len(axes)
    x = F.array(*[col(a).cast("double") + F.lit(0.0) for a in axes])
    points = rows.select(col(key).cast("long").alias("id"), x.alias("x")).groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    points = stored(points.select("id", "n", "x"))
    count, total = points.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    active, merges, steps = points.select("id", (F.col("n") / F.lit(float(max(1, total)))).alias("w"), "n", "x"), None, 0
    box = _box(points, p) if count else None  # all later centres lie in it
    while count > max(1, most):
        near = nearest(active, box, count, cell_points)
        both = near.groupBy(F.least("id", "partner").alias("keep"), F.greatest("id", "partner").alias("gone"))  # twice where it is mutual
        pairs = both.agg(F.count("*").alias("m"), F.min("cost").alias("height")).where("m = 2").select("keep", "gone", "height")
        side = lambda c, s: active.select(F.col("id").alias(c), *[F.col(v).alias(f"{v}_{s}") for v in ("w", "n", "x")])
        found = stored(pairs.join(side("keep", "k"), "keep").join(side("gone", "g"), "gone").withColumn("step", F.lit(steps)))
        w = F.col("w_k") + F.col("w_g")
        middle = F.zip_with("x_k", "x_g", lambda a, b: (F.col("w_k") * a + F.col("w_g") * b) / w)
        changed = found.select(F.col("keep").alias("id"), w.alias("w2"), (F.col("n_k") + F.col("n_g")).alias("n2"), middle.alias("x2"))
        left = active.join(found.select(F.col("gone").alias("id")), "id", "left_anti").join(changed, "id", "left")
        active = stored(left.select("id", *[F.coalesce(f"{c}2", c).alias(c) for c in ("w", "n", "x")]))
        merges = found if merges is None else merges.unionByName(found)
        count, steps = count - found.count(), steps + 1
    if merges is None:
        merges = rows.sparkSession.createDataFrame([], "keep long, gone long, height double, w_k double, n_k long, x_k array<double>, w_g double, n_g long, x_g array<double>, step int")
    return Forest(points, merges, active.orderBy("id").toPandas(), steps)


def silhouettes(rows: DataFrame, axes: Sequence[str], labels: Sequence[str], tolerance: float = 0.0, cell_rows: int = CELL_ROWS) -> list[float]:
    """The mean Euclidean silhouette of all rows for each of several label columns (labels from 0); clusters of one row count 0.

    Every row's distances to a label's rows are summed cell by cell. With ``tolerance`` 0 all sums are exact, which is work
    by the square of the rows. Otherwise a cell's part of a label that is far enough away is summed at once: the mean
    distance lies between that to its centre c and the root of c^2 plus its scatter, and where these are within a share of
    ``tolerance``, half-way is taken; only near cells are read row by row. Two cells meet at a time, so none is gathered.
    """
    p, held = len(axes), rows.select(F.array(*[col(a).cast("double") for a in axes]).alias("x"), F.array(*[col(c).cast("int") for c in labels]).alias("g"))
    count = held.count()
    if not count:
        return [0.0] * len(labels)
    celled = _celled(held.withColumn("id", F.monotonically_increasing_id()), _box(held, p), -(-count // cell_rows))
    marks = F.explode(F.transform("g", lambda v, i: F.struct(i.alias("label"), v.alias("value")))).alias("m")
    sizes = celled.select(marks).groupBy("m.label", "m.value").agg(F.count("*").alias("n")).toPandas().sort_values(["label", "value"])
    of = {(a, b): i for i, (a, b) in enumerate(zip(sizes["label"], sizes["value"], strict=True))}
    n, width = sizes["n"].to_numpy(float), len(sizes)
    span = [np.array([of[k] for k in of if k[0] == i]) for i in range(len(labels))]
    mean = [F.avg(F.element_at("x", a + 1)).alias(f"m{a}") for a in range(p)]
    scatter = [F.var_pop(F.element_at("x", a + 1)).alias(f"v{a}") for a in range(p)]
    balls = celled.select("cell", "x", marks).groupBy("cell", "m.label", "m.value").agg(F.count("*").alias("n"), *mean, *scatter).toPandas()
    cell_of, size = balls["cell"].to_numpy(int), balls["n"].to_numpy(float)
    slot = np.array([of[k] for k in zip(balls["label"], balls["value"], strict=True)])
    centre, spread = balls[[f"m{a}" for a in range(p)]].to_numpy(float), balls[[f"v{a}" for a in range(p)]].to_numpy(float).sum(1)

    def far(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums over far cells, and the cells that must be read."""
        x = np.stack(rows["x"].to_numpy())
        sums, near = np.zeros((len(x), width)), set(cell_of.tolist())
        if tolerance > 0:
            for c in sorted(near):
                at = np.flatnonzero(cell_of == c)
                d2 = ((x[:, None, :] - centre[None, at, :]) ** 2).sum(2)
                low, high = np.sqrt(d2), np.sqrt(d2 + spread[at])
                if (high - low <= tolerance * low).all():
                    near.discard(c)
                    for j, ball in enumerate(at):
                        sums[:, slot[ball]] += size[ball] * (low[:, j] + high[:, j]) / 2
        return pd.DataFrame({"cell": rows["cell"], "id": rows["id"], "x": rows["x"], "g": rows["g"], "sums": list(sums), "near": [sorted(near)] * len(x)})

    def meet(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({"id": [], "g": [], "sums": []})
        xa, xb, g = np.stack(asked["x"].to_numpy()), np.stack(there["x"].to_numpy()), np.stack(there["g"].to_numpy())
        member = np.zeros((len(xb), width))
        for i in range(len(labels)):
            member[np.arange(len(xb)), [of[i, v] for v in g[:, i].tolist()]] = 1.0
        out = []
        for a in range(0, len(xa), 512):
            d2 = np.zeros((len(xa[a : a + 512]), len(xb)))
            for k in range(p):
                d2 += (xa[a : a + 512, k, None] - xb[None, :, k]) ** 2
            out.append(np.sqrt(d2) @ member)
        return pd.DataFrame({"id": asked["id"].to_numpy(), "g": asked["g"].to_numpy(), "sums": list(np.concatenate(out))})

    def widths(batches):
        """Sums of the rows' silhouettes by label."""
        total = np.zeros(len(labels))
        for batch in batches:
            if not len(batch):
                continue
            sums, g = batch[[f"s{i}" for i in range(width)]].to_numpy(float), np.stack(batch["g"].to_numpy())
            for i, at in enumerate(span):
                own = np.array([of[i, v] for v in g[:, i].tolist()])
                rows_ = np.arange(len(g))
                inner = sums[rows_, own] / np.maximum(n[own] - 1, 1)
                means = sums[:, at] / n[at]
                means[own[:, None] == at[None, :]] = np.inf
                outer = means.min(1)
                ok = (n[own] > 1) & np.isfinite(outer)
                outer = np.where(ok, outer, 0.0)
                total[i] += np.where(ok, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0).sum()
        yield pd.DataFrame({"label": range(len(labels)), "s": total})

    kind = "id long, g array<int>, sums array<double>"
    first = stored(celled.groupBy("cell").applyInPandas(far, f"cell int, {kind.replace('g array', 'x array<double>, g array')}, near array<int>"))
    asked = first.select("id", "x", "g", F.col("cell").alias("a"), F.explode("near").alias("b"))
    wanted = first.select(F.col("cell").alias("a"), "near").groupBy("a").agg(F.first("near").alias("near")).select("a", F.explode("near").alias("b"))
    there = celled.select("x", "g", F.col("cell").alias("b")).join(wanted, "b")
    exact = asked.groupBy("a", "b").cogroup(there.groupBy("a", "b")).applyInPandas(meet, kind)
    every = first.select("id", "g", "sums").unionByName(exact) if tolerance > 0 else exact
    summed = every.groupBy("id").agg(F.first("g").alias("g"), *[F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(width)])
    found = summed.mapInPandas(widths, "label int, s double").groupBy("label").agg(F.sum("s").alias("s")).collect()
    by = {r.label: r.s for r in found}
    return [by.get(i, 0.0) / count if len(span[i]) > 1 else 0.0 for i in range(len(labels))]
