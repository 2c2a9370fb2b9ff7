"""Steps whose work or memory grows with the rows: what they send, and that bounded pieces give the whole result."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from multifactor.operators import cluster, moments, quantiles, retention


def sent(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    rest = [getattr(store, f"stageList$default${i}")() for i in range(2, 6)]
    stages = store.stageList(None, *rest)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize(("stretch", "buffer"), [(1 << 22, 1 << 21), (800, 1100)])
def test_permuted_columns_move_packed_and_meet_whole(spark, monkeypatch, stretch, buffer):
    if hasattr(retention, "STRETCH"):
        monkeypatch.setattr(retention, "STRETCH", stretch)
        monkeypatch.setattr(retention, "BUFFER", buffer)
    rng, n = np.random.default_rng(5), 4001
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + 7
    holes = [None, *x[1:, 1].tolist()]
    rows = spark.createDataFrame([(float(a), b, float(c)) for a, b, c in zip(x[:, 0], holes, x[:, 2], strict=True)], "a double, b double, c double").repartition(3)
    kept = rows.localCheckpoint()
    before = sent(spark)
    found = retention.parallel_permuted(kept, ["a", "b", "c"], 7, seed=3, together=3).toPandas()
    assert sent(spark) - before < n  # 7 x 3 x n values
    z = kept.select("a", "b", "c").toPandas().to_numpy(float)
    z = np.nan_to_num(z - np.nanmean(z, axis=0))
    for b in range(7):
        own = np.zeros_like(z)
        for j in range(3):
            own[retention.permuted(np.arange(n), n, 3 + (b << 20) + j) if j else np.arange(n), j] = z[:, j]
        want = np.sort(np.linalg.eigvalsh(own.T @ own / (n - 1)))[::-1]
        assert np.allclose(found[found["replicate"] == b].sort_values("axis")["value"], want)


def on_disk(spark) -> int:
    """Bytes of shuffle files that are still there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def shuffled(spark) -> dict[int, int]:
    """Bytes that each stage so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    rest = [getattr(store, f"stageList$default${i}")() for i in range(2, 6)]
    stages = store.stageList(None, *rest)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_permuted_values_move_without_places_and_leave_no_files(spark, monkeypatch):
    n, draws = 40_000, []
    kept = spark.range(n).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")).localCheckpoint()
    for moved, together, rounds in ((1 << 30, 3, 2), (5 * n, 2, 3)):  # the second bound holds two replicates
        monkeypatch.setattr(retention, "MOVED", moved, raising=False)
        held, before = on_disk(spark), shuffled(spark)
        draws.append(retention.parallel_permuted(kept, ["a", "b", "c"], 6, together=3).toPandas()["value"])
        written = [size for stage, size in shuffled(spark).items() if stage not in before and size > 8 * n]
        until = time.monotonic() + 20
        while on_disk(spark) > held + 8 * n and time.monotonic() < until:  # those of means and counts may stay
            time.sleep(0.2)
        assert on_disk(spark) < held + 8 * n
        assert len(written) == rounds and max(written) < 9 * (1 + 2 * together) * n  # 8 bytes a value, the first column once
    assert np.allclose(*draws)


def test_places_lead_back_to_their_numbers():
    for n in (1, 5, 4097, 3 << 31, 3 << 40):  # from tables, and without
        numbers = np.unique(np.linspace(0, n - 1, 5000).astype(np.int64))
        places = retention.permuted(numbers, n, 9)
        assert places.min() >= 0 and places.max() < n and (retention.permuted(places, n, 9, back=True) == numbers).all()


def test_permuting_no_rows_gives_no_draws(spark):
    none = spark.range(0).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    assert retention.parallel_permuted(none, ["a", "b"], 2).count() == 0


@pytest.mark.parametrize("held", [True, False])
def test_quantiles_sort_only_what_lies_near_them(spark, monkeypatch, held):
    rng, p = np.random.default_rng(8), [0, 0.1, 0.25, 0.5, 0.97, 1]
    monkeypatch.setattr(quantiles, "IN_ONE_AGGREGATION", 1)
    if hasattr(quantiles, "ACCURACY"):
        monkeypatch.setattr(quantiles, "ACCURACY", 200)
        if not held:  # as if an approximation had failed
            monkeypatch.setattr(quantiles, "_between", lambda *_: None)
    x, ties, g = rng.normal(size=9000), rng.integers(0, 5, 9000).astype(float), rng.choice(["a", "b", "few", ""], 9000, p=[0.5, 0.3, 0.01, 0.19])
    rows = spark.createDataFrame([(*map(float, v), k or None) for *v, k in zip(x, ties, g, strict=True)], "x double, ties double, g string").repartition(5).localCheckpoint()
    before = sent(spark)
    got = quantiles.quantiles(rows, {"x": F.col("x"), "ties": F.col("ties")}, p)
    assert np.allclose(got["x"], np.quantile(x, p)) and np.allclose(got["ties"], np.quantile(ties, p))
    groups = {r[0] or "": r[1:] for r in quantiles.group_quantiles(rows, F.col("x"), F.col("g"), p).collect()}
    assert set(groups) == set(g) and all(np.allclose(groups[k], np.quantile(x[g == k], p)) for k in groups)
    assert not held or sent(spark) - before < 9000  # twice 9000 distinct values


@pytest.mark.parametrize("axes", [1, 2, 5])
def test_nearest_centres_hold_no_cube_of_differences(axes):
    rng, n = np.random.default_rng(axes), 10_000
    x, centres = rng.normal(size=(n, axes)).round(1), rng.normal(size=(300, axes)).round(1)  # with many equal distances
    tracemalloc.start()
    got = cluster.nearest_centres([*x.T], centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == ((x[:, None, :] - centres) ** 2).sum(2).argmin(1)).all() and peak < 4e6
    assert len(cluster.nearest_centres([*x[:0].T], centres)) == 0


def test_gram_of_products_needs_one_worker_for_each_task(spark):
    rng = np.random.default_rng(3)
    x, by = rng.normal(size=(500, 4)), rng.normal(size=(4, 3))
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>").repartition(6)
    assert np.allclose(moments.gram_of_rows(rows, 4, by), (x @ by).T @ (x @ by)) and np.allclose(moments.gram_of_rows(rows.where("false"), 4, by), 0)
