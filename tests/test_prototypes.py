"""Prototypes of large tables start from all of their rows."""

import numpy as np
from pyspark.sql import functions as F

from multifactor.operators import cluster


def test_prototypes_start_from_the_whole_table(spark, monkeypatch):
    starts, consolidate = [], cluster.consolidate
    monkeypatch.setattr(cluster, "consolidate", lambda rows, axes, centres, *rest: starts.append(centres) or consolidate(rows, axes, centres, *rest))
    rows = spark.range(0, 8000, 1, 8).select(F.col("id").alias("_row"), F.col("id").cast("double").alias("F1"))
    cluster.hcpc(rows, ["F1"], 2, exact=False)
    counts = np.histogram(starts[0][:, 0], bins=4, range=(0, 8000))[0]
    assert counts.min() > 40
