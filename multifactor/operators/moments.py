"""The heavy jobs: one pass for means and scales, one pass for a (weighted) Gram matrix of centred columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multifactor.functions.columns import col

#: Up to so many columns the Gram matrix is one aggregation of expressions; beyond, blocks of numpy.
EXPRESSION_COLUMNS = 32


@dataclass(frozen=True)
class Moments:
    """Rows, means and standard deviations (sample and population) of some columns."""

    n: int
    mean: np.ndarray
    sd: np.ndarray
    sd_population: np.ndarray


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of each column over its own non-null values, in one aggregation; n counts all rows."""
    figures = [f(col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_samp, F.stddev_pop)]
    row = df.agg(F.count(F.lit(1)), *figures).first()
    table = np.array([np.nan if v is None else float(v) for v in row[1:]]).reshape(-1, 3)
    return Moments(row[0], *table.T)


def matrix_of_arrays(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of ``width`` numbers as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def gram_of_rows(rows: DataFrame, width: int, by: np.ndarray | None = None) -> np.ndarray:
    """X'X of ``rows``' one column, arrays of ``width`` numbers: a matrix from each task, its lines added up by line.

    With ``by`` (width x any) X is the column times it, multiplied in the same worker.
    """
    read, width = width, width if by is None else by.shape[1]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix_of_arrays(batch.column(0), read)
            x = x if by is None else x @ by
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(width, dtype=np.int32), "line": [*total]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, line in zip(batch.column(0).to_pylist(), matrix_of_arrays(batch.column(1), width), strict=True):
                total[i] = total[i] + line if i in total else line
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "line": pa.array(list(total.values()), pa.list_(pa.float64()))})

    schema = "i int, line array<double>"
    out = np.zeros((width, width))
    for r in rows.mapInArrow(inside, schema).repartition("i").mapInArrow(add, schema).collect():
        out[r.i] = r.line
    return (out + out.T) / 2


def gram(df: DataFrame, coded: Sequence[Column], centre: Sequence[float], weight: Column | None = None) -> tuple[np.ndarray, float]:
    """Sum of w (x - c)(x - c)' over all rows, and the sum of w (rows without weights).

    Columns are centred before products are summed, so nothing cancels. Few columns are summed as expressions with
    partial aggregation; many go block by block through numpy, one matrix from each task, added up by Spark row by row.
    """
    p = len(coded)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(w.alias("w"), *[(c.cast("double") - F.lit(float(m))).alias(f"x{i}") for i, (c, m) in enumerate(zip(coded, centre, strict=True))])
    if p <= EXPRESSION_COLUMNS:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        row = rows.agg(F.sum("w"), *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
        out = np.zeros((p, p))
        for (i, j), v in zip(pairs, row[1:], strict=True):
            out[i, j] = out[j, i] = v or 0.0
        return out, row[0] or 0.0

    root = F.sqrt("w")
    out = gram_of_rows(rows.select(F.array(root, *[root * F.col(f"x{i}") for i in range(p)])), p + 1)
    return out[1:, 1:], float(out[0, 0])


def projection(coded: Sequence[Column], centre: Sequence[float], vectors: np.ndarray, prefix: str) -> list[Column]:
    """Columns prefix1, prefix2, ...: the centred coded columns times each vector."""
    out = []
    for k in range(vectors.shape[1]):
        terms = [(c.cast("double") - F.lit(float(m))) * F.lit(float(v)) for c, m, v in zip(coded, centre, vectors[:, k], strict=True)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out.append(total.alias(f"{prefix}{k + 1}"))
    return out
