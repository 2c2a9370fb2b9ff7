"""Tables in the layout in which they are handed on, and reading by a file's ending."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from multifactor import api
from multifactor.operators import describe, layouts, rotation

NAMES = ["a", "b.c", "d`e", "f"]


@pytest.fixture(scope="module")
def turned():
    rng = np.random.default_rng(4)
    r = np.corrcoef(rng.normal(size=(200, 4)) + rng.normal(size=(200, 1)), rowvar=False)
    values, vectors = np.linalg.eigh(r)
    return r, rotation.rotate(vectors[:, -2:] * np.sqrt(values[-2:]), "oblimin")


def test_matrices_have_a_line_for_each_variable(spark, turned):
    r, found = turned
    structure = layouts.structure_table(spark, found, NAMES)
    assert structure.columns == ["variable", "F1", "F2"] and np.allclose(structure.toPandas()[["F1", "F2"]], found.pattern @ found.phi)
    left = layouts.residual_matrix(spark, r, found, NAMES)
    assert left.columns == ["variable", *NAMES] and np.allclose(left.toPandas()[NAMES], describe.residuals(r, found.pattern, found.phi)["matrix"])
    assert layouts.correlation_table(spark, r, NAMES).toPandas()[NAMES].to_numpy().tolist() == np.round(r, 6).tolist()


def test_bars_are_ordered_by_size_on_each_axis(spark, turned):
    a = turned[1].pattern
    bars = layouts.loading_bars(spark, a, NAMES, threshold=0.5).toPandas()
    for k, part in bars.groupby("axis"):
        order = np.argsort(-np.abs(a[:, k - 1]), kind="stable")
        assert part.sort_values("place")["variable"].tolist() == [NAMES[j] for j in order] and (part["over"] == (part["loading"].abs() >= 0.5)).all()
    assert layouts.loading_bars(spark, a, NAMES, by_size=False).where("axis = 1").orderBy("place").toPandas()["variable"].tolist() == NAMES


def test_groups_of_a_map_come_in_their_first_order(spark):
    rows = spark.createDataFrame([(1, None), (2, "z"), (3, ""), (4, "a"), (5, "z")], "_row long, k string")
    assert [tuple(r) for r in layouts.group_levels(rows, "k").orderBy("place").collect()] == [("z", 1, 2), ("a", 2, 1)]
    assert sorted(map(tuple, layouts.group_rows(rows, "k").collect())) == [("a", 2, 4), ("z", 1, 2), ("z", 1, 5)]
    many = spark.range(100_001).select(F.col("id").alias("_row"), F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError):
        layouts.group_levels(many, "k")


def test_supplementary_table_of_nothing(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "F1 double, F2 double")
    assert layouts.supplementary_table(rows, [], [], ["F1", "F2"]).count() == 0


def test_files_are_read_by_their_ending(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    api.read_file(spark, str(tmp_path / "t.csv")).drop("_row").write.parquet(str(tmp_path / "t.parquet"))
    api.read_file(spark, str(tmp_path / "t.csv")).drop("_row").write.json(str(tmp_path / "t.json"))
    for ending in ("csv", "parquet", "json"):
        got = api.read_file(spark, str(tmp_path / f"t.{ending}"))
        assert got.columns == ["a", "b", "_row"] and sorted((r.a, r.b) for r in got.collect()) == [("1", "x"), ("2", "y")]
