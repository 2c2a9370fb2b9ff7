"""How many axes to keep: broken stick, parallel analysis, minimum average partial, criteria and their consensus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.functions.columns import col
from multifactor.functions.linalg import eigen_symmetric, to_correlation
from multifactor.operators.moments import moments
from multifactor.operators.pca import Pca
from multifactor.operators.storage import shuffles_freed, stored


#: Values of a stretch of places that a task of a permutation holds, all columns and replicates of a round together; values that
#: a task packs at once to send them.
STRETCH, BUFFER = 1 << 22, 1 << 21
#: Values that a round of a permutation moves to its places at most, 8 GB on disk, unless one replicate has more.
MOVED = 1 << 30
#: Values that are stored as one row, so that Spark handles few rows and its batches of rows stay small.
LOT = 192


@dataclass(frozen=True)
class Criterion:
    """A rule's number of axes and its weight in the consensus."""

    name: str
    k: int
    weight: int


def broken_stick(p: int, total: float) -> np.ndarray:
    """Expected eigenvalues of a total broken at random in p parts, largest first."""
    return total / p * np.cumsum(1 / np.arange(p, 0, -1))[::-1]


def parallel_normal(spark, n: int, p: int, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(replicate, axis, value): eigenvalues of correlations of n x p normal draws.

    The centred cross-products of n normal rows follow Wishart's distribution with n - 1 degrees of freedom, which
    Bartlett's decomposition draws as a p x p triangle: work does not grow with n. With fewer than p degrees the rows
    themselves are drawn.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                rng = np.random.default_rng([seed, int(b)])
                if n > p:
                    triangle = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(n - 1 - np.arange(p))))
                    products = triangle @ triangle.T
                else:
                    x = rng.standard_normal((n, p))
                    products = (x - x.mean(0)).T @ (x - x.mean(0))
                yield pd.DataFrame({"replicate": int(b), "axis": np.arange(1, p + 1), "value": eigen_symmetric(to_correlation(products))[0]})

    return spark.range(replicates).repartition(min(replicates, spark.sparkContext.defaultParallelism)).mapInPandas(draw, "replicate long, axis int, value double")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(64)
def _rounds(bits: int, key: int) -> list[Callable[[np.ndarray], np.ndarray]]:
    """What each of six Feistel rounds adds, by the other half; from tables where a half has up to 16 bits."""
    keys = _mixed(np.uint64(key & (2**64 - 1)) + np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sizes = (bits // 2, bits - bits // 2)

    def added(half: np.ndarray, k: np.uint64, size: int) -> np.ndarray:
        return (_mixed(half.astype(np.uint64) ^ k) & np.uint64((1 << size) - 1)).astype(np.int64)

    if sizes[1] > 16:
        return [partial(added, k=k, size=sizes[r % 2]) for r, k in enumerate(keys)]
    return [added(np.arange(1 << sizes[1 - r % 2]), k, sizes[r % 2]).astype(np.uint16).take for r, k in enumerate(keys)]


def permuted(numbers: np.ndarray, n: int, key: int, *, back: bool = False) -> np.ndarray:
    """The places of ``numbers`` (of 0 .. n - 1) in a permutation that ``key`` fixes, each computed by itself.

    Six Feistel rounds permute the least power of two that holds ``n``; a number that leaves the range is sent on until it
    is back, at most twice on average, which keeps the whole a permutation. With ``back``, the numbers that have the places.
    """
    bits = max(2, int(n - 1).bit_length())
    rounds, low = _rounds(bits, key), bits - bits // 2

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> low, v & ((1 << low) - 1)
        for added in reversed(rounds) if back else rounds:
            left, right = (right ^ added(left), left) if back else (right, left ^ added(right))
        return (left << low) | right

    out = once(np.asarray(numbers).astype(np.int64))
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = moved = once(out[beyond])
        beyond = beyond[moved >= n]
    return out


def parallel_permuted(df: DataFrame, names: Sequence[str], replicates: int = 20, seed: int = 42, together: int = 5) -> DataFrame:
    """(replicate, axis, value): eigenvalues of covariances after each column is permuted on its own.

    Rows are packed and numbered once, from counts by task. A value's place in a replicate is a keyed permutation of its row's
    number, so nothing is sorted: columns and ``together`` replicates meet by stretches of places in one shuffle, or fewer
    replicates if these are more than MOVED values; its files go before the next round. A task sends a stretch its values of a
    run of rows as one row of packed numbers in the order of the rows. Places are not sent: the stretch finds which rows its
    places have by the permutation's inverse. Its products are added up. The first column keeps its place and moves once for
    all replicates of a round. Only matrices of p x p reach the driver.
    """
    spark, p = df.sparkSession, len(names)
    m = moments(df, names)
    lot = max(1, LOT // p)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, past = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = np.ascontiguousarray(batch.to_numpy(float))
            lots = [x[s : s + lot] for s in range(0, len(x), lot)]
            yield pd.DataFrame({"task": task, "first": [past + s for s in range(0, len(x), lot)], "m": [len(one) for one in lots], "x": [one.tobytes() for one in lots]})
            past += len(x)

    # a missing value adds nothing to the products
    centred = df.select(*[F.coalesce(col(c).cast("double") - F.lit(float(v)), F.lit(0.0)).alias(f"x{j}") for j, (c, v) in enumerate(zip(names, m.mean, strict=True))])
    rows = stored(centred.mapInPandas(pack, "task int, first long, m int, x binary"))
    counts = rows.groupBy("task").agg(F.sum("m").alias("m"))
    past = counts.select("task", F.coalesce(F.sum("m").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("past"))  # a row for each task
    numbered = rows.join(F.broadcast(past), "task").select((F.col("past") + F.col("first")).alias("i"), "x")
    n = counts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    together = max(1, min(together, MOVED // max(1, n * (p - 1))))
    slots, out = 1 + (p - 1) * together, []
    size = max(1, min(STRETCH // slots, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    parts, buffered = -(-n // size), max(1, BUFFER // slots)
    key_type = np.uint16 if parts <= 1 << 16 else np.int64  # short keys are sorted by digits

    def dealing(first: int):
        moves = [(b, j) for b in range(first, min(first + together, replicates)) for j in range(1, p)]

        def packed(start: int, lots: list[bytes]) -> pd.DataFrame:
            x = np.frombuffer(b"".join(lots)).reshape(-1, p).T
            i = start + np.arange(x.shape[1])
            part = np.concatenate([i, *[permuted(i, n, seed + (b << 20) + j) for b, j in moves]]) // size
            order = np.argsort(part.astype(key_type), kind="stable")  # by part, then column of a replicate, then row
            slot, values = order // len(i), np.concatenate([x[0], *[x[j] for _, j in moves]])[order]
            met, held = np.unique(part, return_counts=True) if parts > 1 << 22 else (np.arange(parts), np.bincount(part, minlength=parts))
            ends = np.cumsum(held)
            spans = [(int(k), int(e - h), int(e)) for k, h, e in zip(met, held, ends, strict=True) if h]
            sizes = [np.bincount(slot[s:e], minlength=len(moves) + 1).astype(np.uint32).tobytes() for _, s, e in spans]
            return pd.DataFrame({"part": [k for k, _, _ in spans], "row": start, "sizes": sizes, "x": [values[s:e].tobytes() for _, s, e in spans]})

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lots, start, end = [], 0, 0
            for batch in batches:
                for i, x in zip(batch["i"], batch["x"], strict=True):
                    if lots and (i != end or end - start >= buffered):
                        yield packed(start, lots)
                        lots = []
                    if not lots:
                        start = i
                    lots.append(x)
                    end = i + len(x) // (8 * p)
            if lots:
                yield packed(start, lots)

        def products(group: pd.DataFrame) -> pd.DataFrame:
            group, start = group.sort_values("row"), int(group["part"].iloc[0]) * size
            places, found = np.arange(start, min(start + size, n)), []
            ends = np.cumsum([np.frombuffer(s, np.uint32) for s in group["sizes"]], axis=1)
            sent = [np.split(np.frombuffer(x), e[:-1]) for x, e in zip(group["x"], ends, strict=True)]

            def column(slot: int) -> np.ndarray:
                x = np.concatenate([s[slot] for s in sent])
                if slot:
                    b, j = moves[slot - 1]
                    x[np.argsort(permuted(places, n, seed + (b << 20) + j, back=True))] = x.copy()
                return x

            own, (i, j) = np.empty((p, len(places))), np.triu_indices(p)
            own[0] = column(0)
            for k, b in enumerate(range(first, min(first + together, replicates))):
                for c in range(1, p):
                    own[c] = column(k * (p - 1) + c)
                found.append(pd.DataFrame({"b": np.int32(b), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": (own @ own.T)[i, j]}))
            return pd.concat(found)

        return deal, products

    for first in range(0, replicates, together):
        deal, products = dealing(first)
        sums: dict[int, np.ndarray] = {}
        with shuffles_freed(spark):
            met = numbered.mapInPandas(deal, "part long, row long, sizes binary, x binary").groupBy("part").applyInPandas(products, "b int, i int, j int, v double")
            for row in met.groupBy("b", "i", "j").agg(F.sum("v").alias("v")).collect():
                g = sums.setdefault(row.b, np.zeros((p, p)))
                g[row.i, row.j] = g[row.j, row.i] = row.v
        out += [(b, k + 1, float(v)) for b, g in sorted(sums.items()) for k, v in enumerate(eigen_symmetric(g / max(n - 1, 1))[0])]
    return spark.createDataFrame(out, "replicate long, axis int, value double")


def parallel_summary(draws: DataFrame) -> DataFrame:
    """(axis, mean, p95) of a parallel analysis."""
    return draws.groupBy("axis").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"))


def velicer(r: np.ndarray) -> dict[str, object]:
    """Average squared and fourth-power partial correlations after 0, 1, ... axes; the axes at their minima."""
    p = len(r)
    values, vectors = eigen_symmetric(r)
    off = ~np.eye(p, dtype=bool)
    series = [(0, float((r[off] ** 2).mean()), float((r[off] ** 4).mean()))] if p > 1 else [(0, 0.0, 0.0)]
    left = np.array(r, float)
    for m in range(1, p):
        left -= max(values[m - 1], 0.0) * np.outer(vectors[:, m - 1], vectors[:, m - 1])  # one axis less: a downdate of rank one
        d = np.diag(left)
        if (d <= 1e-10).any():
            break
        c2 = left**2 / np.outer(d, d)
        np.fill_diagonal(c2, 0.0)
        series.append((m, float(c2.sum() / (p * (p - 1))), float((c2**2).sum() / (p * (p - 1)))))
    return {"series": series, "k": min(series, key=lambda s: s[1])[0], "k4": min(series, key=lambda s: s[2])[0]}


def leading(values: Sequence[float], bar: Sequence[float]) -> int:
    """Axes before the first that does not exceed its bar."""
    over = [v > b for v, b in zip(values, bar, strict=True)]
    return over.index(False) if False in over else len(over)


def reaching(cumulative: Sequence[float], share: float) -> int:
    """The first axis at which the cumulated share is reached; all axes if none."""
    return next((i + 1 for i, c in enumerate(cumulative) if c >= share), len(cumulative))


def elbow(values: Sequence[float]) -> int:
    """The inner axis of the sharpest bend of the scree (the first of equals); 1 with two axes or fewer."""
    bends = [values[i - 1] - 2 * values[i] + values[i + 1] for i in range(1, len(values) - 1)]
    return 2 + int(np.argmax(bends)) if bends else 1


def criteria(found: Pca, horn_p95: Sequence[float]) -> list[Criterion]:
    """Eight rules. Without correlations, the rules of eigenvalue 1 and 0.7 both become that of the mean eigenvalue."""
    v, p = found.values, found.p
    above_mean = int((v > found.total / p).sum())
    kaiser = int((v > 1).sum()) if found.is_correlation else above_mean
    jolliffe = int((v > 0.7).sum()) if found.is_correlation else above_mean
    return [
        Criterion("parallel analysis", max(1, leading(v, horn_p95)), 3),
        Criterion("Kaiser-Guttman" if found.is_correlation else "mean eigenvalue", max(1, kaiser), 1),
        Criterion("broken stick", max(1, leading(v, broken_stick(p, found.total))), 2),
        Criterion("minimum average partial", max(1, velicer(found.correlation)["k"]), 2),
        Criterion("scree elbow", elbow(v), 1),
        Criterion("70 % of variance", reaching(found.cumulative, 0.70), 1),
        Criterion("80 % of variance", reaching(found.cumulative, 0.80), 1),
        Criterion("Jolliffe", max(1, jolliffe), 1),
    ]


def consensus(rules: Sequence[Criterion]) -> int:
    """The number of axes with most weight; the smaller of equals."""
    votes: Counter[int] = Counter()
    for c in rules:
        votes[c.k] += c.weight
    return min(votes, key=lambda k: (-votes[k], k))


def eigenvalue_table(spark, found: Pca, chosen: int, horn_p95: Sequence[float] | None = None) -> DataFrame:
    """The axis frame with the drop to the next eigenvalue, the random and broken-stick bars, and whether retained."""
    stick = broken_stick(found.p, found.total)
    bars = spark.createDataFrame([(k + 1, float(s), None if horn_p95 is None else float(horn_p95[k]), k < chosen) for k, s in enumerate(stick)], "axis int, stick double, p95 double, retained boolean")
    return found.axes(spark).join(bars, "axis").withColumn("drop", F.col("eigenvalue") - F.lead("eigenvalue").over(W.orderBy("axis")))


def retention_note(cumulative: float, k: int) -> str:
    """What to say about the share of variance that k axes hold."""
    if k == 1:
        return "one axis: there is no plane to draw"
    if cumulative < 0.5:
        return "under half of the variance: read the maps with care"
    return "over 95 % with more than two axes: fewer may do" if cumulative > 0.95 and k > 2 else "adequate"
