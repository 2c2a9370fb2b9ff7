"""Leading axes of tables with any number of levels: a block Krylov method over distributed sparse matrices.

Only matrices as large as the number of axes times the number of steps reach the driver; levels stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.functions.columns import col
from multifactor.operators.moments import gram_of_rows, matrix_of_arrays
from multifactor.operators.storage import stored

#: Axes in a block beyond those asked for; steps at most; when a residual is small enough, as a share of the first value.
SPARE, MOST_STEPS, TOLERANCE = 3, 40, 1e-8


def _times(rows: DataFrame, keep: Sequence[str], x: Column, by: np.ndarray, name: str) -> DataFrame:
    """``keep`` and ``name``: each row's array ``x`` times the matrix ``by``."""
    width, out_width = by.shape
    kept = rows.select(*keep, x.alias("_x"))
    schema = kept.drop("_x").schema.add(name, T.ArrayType(T.DoubleType()))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix_of_arrays(batch.column(len(keep)), width) @ by
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * out_width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[f.name for f in schema.fields])

    return kept.mapInArrow(multiply, schema)


@dataclass(frozen=True)
class Leading:
    """The largest eigenvalues in order, ``vectors`` (node, x: the node's entry in each vector), and how they were found."""

    values: np.ndarray
    vectors: DataFrame
    residuals: np.ndarray
    steps: int


def leading_eigen(entries: DataFrame, nodes: DataFrame, k: int, *, diagonal: float = 0.0, steps: int = MOST_STEPS, tolerance: float = TOLERANCE, seed: int = 42) -> Leading:
    """The ``k`` largest eigenvalues and unit vectors of a symmetric sparse matrix, orthogonal to a known eigenvector.

    ``entries`` (i, j, v) hold the matrix off its constant ``diagonal``, both halves; ``nodes`` (node, root) all its rows and
    the known vector. A block of k + SPARE random vectors is multiplied by the matrix again and again; each product, made
    orthogonal twice to the whole basis so far, is the next block. The matrix in the basis is small, and so is what it
    leaves out, from which residuals are known: steps end when those of all k are under ``tolerance`` times the first
    value, or when nothing new comes. A value's error is at most its residual, and near its square over the gap.

    A step multiplies in one join and sums by row, meets the basis in another join, and reads the result twice.
    """
    width = k + SPARE
    draw = [F.xxhash64(F.lit(seed + i), F.col("node")) / F.lit(float(1 << 63)) for i in range(width)]
    table = stored(nodes.select("node", F.array(F.col("root").cast("double")).alias("q"), F.array(*draw).alias("w")))
    held, size = 1, width  # vectors in q and in w
    inner = np.zeros((1, 1))
    for step in range(steps + 1):
        both = table.select(F.concat("q", "w").alias("x"))
        g = gram_of_rows(both, held + size)
        if step:  # w is the matrix times the last block of q
            known = inner
            inner = np.zeros((held, held))
            inner[: len(known), : len(known)] = known
            last = slice(held - size, held)
            inner[:, last], inner[last, :] = g[:held, held:], g[:held, held:].T
        project = np.vstack([-g[:held, held:], np.eye(size)])
        rest = project.T @ g @ project
        if step:
            values, turn = np.linalg.eigh((inner[1:, 1:] + inner[1:, 1:].T) / 2)
            order = np.argsort(-values)[:k]
            bottom = turn[-size:, order]
            residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", bottom, rest, bottom), 0))
            done = len(order) == k and bool((residuals <= tolerance * max(values[order[0]], 1e-300)).all())
        scale, axes = np.linalg.eigh((rest + rest.T) / 2)
        fresh = scale > 1e-12 * max(1e-300, np.trace(g[held:, held:]) / size)
        if step and (done or not fresh.any() or step == steps):
            break
        first = project @ (axes[:, fresh] / np.sqrt(scale[fresh]))
        n_new = first.shape[1]
        g2 = gram_of_rows(both, held + size, np.hstack([np.eye(held + size, held), first]))
        again = np.vstack([-g2[:held, held:], np.eye(n_new)])
        scale, axes = np.linalg.eigh(again.T @ g2 @ again)
        good = axes[:, scale > 0.5] / np.sqrt(scale[scale > 0.5])  # what the second pass shrinks was rounding
        block = first @ good + np.vstack([again[:held] @ good, np.zeros((size, good.shape[1]))])
        size = good.shape[1]
        if not size:
            break
        basis = _times(table, ["node"], F.concat("q", "w"), np.hstack([np.eye(len(block), held), block]), "q")
        held += size
        basis = stored(basis)
        latest = basis.select(F.col("node").alias("j"), *[F.element_at("q", held - size + i + 1).alias(f"x{i}") for i in range(size)])
        product = entries.join(latest, "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(f"x{i}")).alias(f"y{i}") for i in range(size)])
        met = basis.join(product.withColumnRenamed("i", "node"), "node", "left")
        new = [F.coalesce(F.col(f"y{i}"), F.lit(0.0)) + F.lit(float(diagonal)) * F.element_at("q", held - size + i + 1) for i in range(size)]
        table = stored(met.select("node", "q", F.array(*new).alias("w")))
    by = np.vstack([np.zeros((1, len(order))), turn[:, order]])
    vectors = _times(table, ["node"], F.col("q"), by, "x")
    return Leading(values[order], stored(_signed(vectors, len(order))), residuals, step)


def _signed(vectors: DataFrame, k: int) -> DataFrame:
    """Vectors turned so that each one's entry of largest magnitude (of equals, the least node's) is positive."""
    rank = lambda i: F.struct(F.round(F.abs(F.element_at("x", i + 1)), 12), F.element_at("x", i + 1) > 0)
    held = stored(vectors)
    signs = held.agg(*[F.max_by(F.signum(F.element_at("x", i + 1)), rank(i)) for i in range(k)]).first()
    return held.select("node", F.array(*[F.element_at("x", i + 1) * F.lit(float(s or 1.0)) for i, s in enumerate(signs)]).alias("x"))


@dataclass(frozen=True)
class WideMca:
    """Leading axes of an MCA: ``levels`` (node, variable, level, n, mass, x: its entry in each axis' unit vector)."""

    variables: list[str]
    n: int
    n_levels: int
    squares: float
    values: np.ndarray
    levels: DataFrame
    residuals: np.ndarray
    steps: int

    @property
    def total(self) -> float:
        """Inertia of all axes."""
        return self.n_levels / len(self.variables) - 1

    @property
    def adjusted(self) -> dict[str, np.ndarray | float]:
        """Benzecri's adjustment of the leading axes over 1/Q, and Greenacre's shares, whose base needs no further axis."""
        q = len(self.variables)
        b = (q / (q - 1) * (self.values[self.values > 1 / q] - 1 / q)) ** 2
        base = q / (q - 1) * (self.squares - (self.n_levels - q) / q**2)
        return {"threshold": 1 / q, "benzecri": b, "greenacre_share": b / base if base > 0 else b * 0, "greenacre_inertia": float(base)}

    def axes(self, spark: SparkSession) -> DataFrame:
        """(axis, eigenvalue, share, cumulative) of the leading axes."""
        share = self.values / self.total
        return spark.createDataFrame([(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(self.values, share, np.cumsum(share), strict=True))], "axis int, eigenvalue double, share double, cumulative double")

    def categories(self) -> DataFrame:
        """(variable, level, n, mass, axis, coord, contribution) of every level."""
        coord = F.transform("x", lambda v, i: F.struct((i + 1).cast("int").alias("axis"), (v * F.sqrt(F.element_at(F.lit(self.values.tolist()), i + 1)) / F.sqrt("mass")).alias("coord"), (100 * v * v).alias("contribution")))
        return self.levels.select("variable", "level", "n", "mass", F.explode(coord).alias("p")).select("variable", "level", "n", "mass", "p.*")

    def rows(self, df: DataFrame, keep: Sequence[str] = ("_row",), prefix: str = "F") -> DataFrame:
        """Coordinates of rows, supplementary ones too: the mean of their levels' vectors over the roots of masses.

        Each variable is one join by level, which Spark splits where a level is frequent; an unknown or missing level adds nothing.
        """
        k = len(self.values)
        out = df.select(*[col(c) for c in keep], *[_node(i, v).alias(f"_n{i}") for i, v in enumerate(self.variables)])
        for i in range(len(self.variables)):
            points = self.levels.where(F.col("variable") == self.variables[i]).select(F.col("node").alias(f"_n{i}"), F.transform("x", lambda v: v / F.sqrt("mass")).alias(f"_x{i}"))
            out = out.join(points, f"_n{i}", "left")
        at = lambda a: reduce(lambda x, y: x + y, [F.coalesce(F.element_at(f"_x{i}", a + 1), F.lit(0.0)) for i in range(len(self.variables))])
        return out.select(*[col(c) for c in keep], *[(at(a) / F.lit(float(len(self.variables)))).alias(f"{prefix}{a + 1}") for a in range(k)])


def _node(i: int, name: str) -> Column:
    return F.concat(F.lit(f"{i}="), col(name).cast("string"))


def wide_mca(df: DataFrame, names: Sequence[str], k: int = 5, **options) -> WideMca:
    """The leading ``k`` axes of the MCA of categorical columns with any number of levels, over rows complete in them.

    The matrix of levels is (I + P) / Q, where P holds n_ij / sqrt(n_i n_j) for two levels of different columns that meet in
    n_ij rows. Spark counts those pairs once, combined in each task; no row is needed after that, and no matrix of levels is
    dense. A frequent level has at most as many entries as there are levels.
    """
    q = len(names)
    if q < 2:
        raise ValueError("two or more columns are needed")
    complete = reduce(lambda x, y: x & y, [col(v).isNotNull() for v in names])
    rows = df.where(complete).select(*[_node(i, v).alias(f"n{i}") for i, v in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.col(f"n{i}").alias("i"), F.col(f"n{j}").alias("j")) for i in range(q) for j in range(i + 1, q)])).alias("p")
    counts = stored(rows.select(pairs).groupBy("p").agg(F.count("*").alias("n")).select("p.*", "n"))
    first = counts.where(F.col("i").startswith("0=") & F.col("j").startswith("1="))  # every row is in one pair of columns 0 and 1
    sizes = counts.where(F.col("i").startswith("0=")).groupBy(F.col("j").alias("node")).agg(F.sum("n").alias("n")).unionByName(first.groupBy(F.col("i").alias("node")).agg(F.sum("n").alias("n")))
    sizes = stored(sizes)
    n, n_levels = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], sizes.count()
    if not n:
        raise ValueError("no row is complete in these columns")
    of = lambda side: sizes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"))
    half = counts.join(of("i"), "i").join(of("j"), "j").select("i", "j", (F.col("n") / F.sqrt(F.col("n_i").cast("double") * F.col("n_j")) / q).alias("v"))
    entries = stored(half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")))
    squares = float(entries.agg(F.sum(F.col("v") * F.col("v"))).first()[0]) + n_levels / q**2 - 1
    mass = F.col("n") / F.lit(float(n * q))
    # Q - 1 vectors besides the trivial one have the value 0, and there are no more than levels
    found = leading_eigen(entries, sizes.select("node", F.sqrt(mass).alias("root")), min(k, n_levels - q), diagonal=1 / q, **options) if n_levels > q else None
    if found is None:
        raise ValueError("every column has one level")
    variable = F.element_at(F.lit(list(names)), (F.substring_index("node", "=", 1).cast("int") + 1))
    levels = sizes.join(found.vectors, "node").select("node", variable.alias("variable"), F.expr("substring(node, instr(node, '=') + 1)").alias("level"), "n", mass.alias("mass"), "x")
    return WideMca(list(names), n, n_levels, squares, found.values, levels, found.residuals, found.steps)


@dataclass(frozen=True)
class WideCorrespondence:
    """Leading axes of a two-way table: inertias, and ``points`` (side, name, n, mass, x: principal coordinates)."""

    values: np.ndarray
    inertia: float
    chi2: float
    n: int
    points: DataFrame
    residuals: np.ndarray
    steps: int

    def axes(self, spark: SparkSession) -> DataFrame:
        """(axis, eigenvalue, share, cumulative) of the leading axes."""
        share = self.values / self.inertia if self.inertia > 0 else np.zeros(len(self.values))
        return spark.createDataFrame([(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(self.values, share, np.cumsum(share), strict=True))], "axis int, eigenvalue double, share double, cumulative double")


def wide_correspondence(df: DataFrame, a: str, b: str, k: int = 5, **options) -> WideCorrespondence:
    """The leading ``k`` axes of the correspondence analysis of two columns with any number of levels on both sides.

    It is the MCA of the two columns with its eigenvalues e turned to singular values 2 e - 1: levels stay in Spark, and so
    does the table, of which only filled cells exist.
    """
    found = wide_mca(df, [a, b], k, **options)
    kept = found.values > 0.5 + 1e-9
    if not kept.any():
        raise ValueError("the two columns are independent: there is no axis")
    sigma = 2 * found.values[kept] - 1
    # a side's masses sum to a half in the MCA, and its part of a unit vector has half the squared length
    coord = F.transform(F.slice("x", 1, int(kept.sum())), lambda v, i: v * F.element_at(F.lit(sigma.tolist()), i + 1) / F.sqrt("half"))
    side = F.when(F.col("node").startswith("0="), "row").otherwise("col")
    points = found.levels.withColumn("half", F.col("mass")).select(side.alias("side"), F.col("level").alias("name"), "n", (2 * F.col("mass")).alias("mass"), coord.alias("x"))
    inertia = 2 * (found.squares + 1) - found.n_levels / 2 - 1
    return WideCorrespondence(sigma**2, inertia, inertia * found.n, found.n, points, found.residuals[kept], found.steps)
