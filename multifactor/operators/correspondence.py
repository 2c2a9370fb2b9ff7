"""Correspondence analysis of a two-way table, and multiple correspondence analysis of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions import distributions as D
from multifactor.functions.linalg import singular_from_gram
from multifactor.operators.gsvd import Gsvd, core, indicators
from multifactor.operators.inference import cramer


@dataclass(frozen=True)
class Correspondence:
    """CA of a table of counts; eigenvalues' shares are of chi2 / n."""

    rows: list[str]
    cols: list[str]
    counts: np.ndarray
    values: np.ndarray
    row_coord: np.ndarray
    col_coord: np.ndarray
    row_mass: np.ndarray
    col_mass: np.ndarray
    chi2: float
    df: int
    p: float

    @property
    def inertia(self) -> float:
        return self.chi2 / self.counts.sum()

    @property
    def share(self) -> np.ndarray:
        return self.values / self.inertia if self.inertia > 0 else np.zeros(len(self.values))

    @property
    def k(self) -> int:
        return len(self.values)

    def points(self, spark: SparkSession) -> DataFrame:
        """(side, name, mass, axis, coord, cos2, contribution) of rows and columns."""
        out = []
        for side, names, mass, coord in (("row", self.rows, self.row_mass, self.row_coord), ("col", self.cols, self.col_mass, self.col_coord)):
            d2 = (coord**2).sum(1)
            for i, n in enumerate(names):
                out += [(side, n, float(mass[i]), k + 1, float(coord[i, k]), float(coord[i, k] ** 2 / d2[i]) if d2[i] > 0 else 0.0, 100 * float(mass[i] * coord[i, k] ** 2 / self.values[k])) for k in range(self.k)]
        return spark.createDataFrame(out, "side string, name string, mass double, axis int, coord double, cos2 double, contribution double")

    def axes(self, spark: SparkSession) -> DataFrame:
        """(axis, eigenvalue, share, cumulative)."""
        c = np.cumsum(self.share)
        return spark.createDataFrame([(i + 1, float(v), float(s), float(x)) for i, (v, s, x) in enumerate(zip(self.values, self.share, c, strict=True))], "axis int, eigenvalue double, share double, cumulative double")

    def cells(self, spark: SparkSession) -> DataFrame:
        """(row, col, observed, expected, residual, contribution) of every cell."""
        e = np.outer(self.row_mass, self.col_mass) * self.counts.sum()
        r = np.divide(self.counts - e, np.sqrt(e), out=np.zeros_like(e), where=e > 0)
        rows = [(a, b, float(self.counts[i, j]), float(e[i, j]), float(r[i, j]), 100 * float(r[i, j] ** 2 / self.chi2) if self.chi2 > 0 else 0.0) for i, a in enumerate(self.rows) for j, b in enumerate(self.cols)]
        return spark.createDataFrame(rows, "row string, col string, observed double, expected double, residual double, contribution double")

    @property
    def standard_cols(self) -> np.ndarray:
        """Column coordinates of the asymmetric map."""
        return self.col_coord / np.sqrt(self.values)


def correspondence(counts: np.ndarray, rows: Sequence[str] | None = None, cols: Sequence[str] | None = None) -> Correspondence:
    """CA of a matrix of counts (levels x levels, small)."""
    counts = np.asarray(counts, float)
    n = counts.sum() if counts.size else 0.0
    if not n > 0:
        raise ValueError("the contingency table is empty")
    p = counts / n
    r, c = p.sum(1), p.sum(0)
    rr, rc = np.sqrt(np.maximum(r, 1e-300)), np.sqrt(np.maximum(c, 1e-300))
    s = np.where(np.outer(r, c) > 0, (p - np.outer(r, c)) / np.outer(rr, rc), 0.0)
    chi2 = float((s**2).sum() * n)
    values, v = singular_from_gram(s.T @ s)
    keep = min(len(values), min(counts.shape) - 1)
    values, v = values[:keep], v[:, :keep]
    f = np.divide(s @ v, rr[:, None], out=np.zeros((len(r), keep)), where=r[:, None] > 0)
    g = np.divide(v * np.sqrt(values), rc[:, None], out=np.zeros_like(v), where=c[:, None] > 0)
    df = max(0, ((r > 0).sum() - 1) * ((c > 0).sum() - 1))
    return Correspondence(list(rows or [f"r{i + 1}" for i in range(len(r))]), list(cols or [f"c{j + 1}" for j in range(len(c))]), counts, values, f, g, r, c, chi2, int(df), D.chi2_tail(chi2, df) if df else 1.0)


def correspondence_of(df: DataFrame, a: str, b: str, order: str = "_row", most: int = 10_000) -> Correspondence:
    """CA of two label columns: Spark counts the cells, one small table of levels reaches the driver.

    Levels come by first appearance in ``order``. More than ``most`` levels in a column are an error: the table is dense.
    """
    table = df.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).groupBy(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    sizes = table.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    if max(sizes) > most or min(sizes) > 2000:
        raise ValueError(f"too many levels for a correspondence table: {sizes[0]} x {sizes[1]}")
    first: tuple[dict[str, int], dict[str, int]] = ({}, {})
    found = table.collect()
    for x in found:
        for names, level in zip(first, (x.a, x.b), strict=True):
            names[level] = min(x["first"], names.get(level, x["first"]))
    rows, cols = (sorted(names, key=lambda v, names=names: (names[v], v)) for names in first)
    at = [{v: i for i, v in enumerate(levels)} for levels in (rows, cols)]
    counts = np.zeros((len(rows), len(cols)))
    for x in found:
        counts[at[0][x.a], at[1][x.b]] = x.n
    return correspondence(counts, rows, cols)


@dataclass(frozen=True)
class Mca:
    """Multiple correspondence analysis: the core of the indicators and the adjusted inertias."""

    core: Gsvd
    variables: list[str]
    variable_of: list[str]
    levels: list[str]
    share_of: np.ndarray
    cramer: DataFrame | None = field(default=None)

    @property
    def q(self) -> int:
        return len(self.variables)

    @property
    def raw_inertia(self) -> float:
        return len(self.levels) / self.q - 1

    @property
    def adjusted(self) -> dict[str, np.ndarray | float]:
        """Benzecri's and Greenacre's adjustment of the axes over 1/Q."""
        q, j, v = self.q, len(self.levels), self.core.values
        if q < 2:
            return {"threshold": 1.0, "benzecri": np.zeros(0), "benzecri_share": np.zeros(0), "greenacre_share": np.zeros(0), "greenacre_inertia": 0.0}
        b = (q / (q - 1) * (v[v > 1 / q] - 1 / q)) ** 2
        base = q / (q - 1) * ((v**2).sum() - (j - q) / q**2)
        return {"threshold": 1 / q, "benzecri": b, "benzecri_share": b / b.sum() if b.size else b, "greenacre_share": b / base if base > 0 else b * 0, "greenacre_inertia": float(base)}

    def axes(self, spark: SparkSession) -> DataFrame:
        """(axis, eigenvalue, share, cumulative, benzecri_share, greenacre_share)."""
        a, c = self.adjusted, np.cumsum(self.core.values / self.raw_inertia)
        at = lambda x, i: float(x[i]) if i < len(x) else None
        rows = [(i + 1, float(v), float(v / self.raw_inertia), float(c[i]), at(a["benzecri_share"], i), at(a["greenacre_share"], i)) for i, v in enumerate(self.core.values)]
        return spark.createDataFrame(rows, "axis int, eigenvalue double, share double, cumulative double, benzecri_share double, greenacre_share double")

    def categories(self, spark: SparkSession) -> DataFrame:
        """(variable, level, share, axis, coord, cos2, contribution)."""
        g = self.core
        c, q, t = g.col_coord, g.col_cos2, g.col_contribution
        rows = [(v, lv, float(s), k + 1, float(c[j, k]), float(q[j, k]), float(t[j, k])) for j, (v, lv, s) in enumerate(zip(self.variable_of, self.levels, self.share_of, strict=True)) for k in range(g.k)]
        return spark.createDataFrame(rows, "variable string, level string, share double, axis int, coord double, cos2 double, contribution double")

    def rows(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """Coordinates of the rows."""
        return self.core.rows(df, k)


def mca(df: DataFrame, names: Sequence[str], order: str = "_row", associations: bool = False) -> Mca:
    """MCA of complete categorical columns: CA of their indicators, from one Gram job of the levels.

    A row's profile is its indicators over Q; all rows weigh the same; a level's mass is its share over Q.
    """
    levels = indicators(df, names, order)
    q, share = len(names), np.array([s for *_, s, _ in levels])
    mass = share / q
    found = core(df, [f"{v}={lv}" for v, lv, *_ in levels], [x / q for *_, x in levels], 1 / mass, mass)
    keep = min(found.k, len(levels) - q)
    found = Gsvd(found.names, found.coded, found.mean, found.metric, found.mass, found.values[:keep], found.vectors[:, :keep], found.gram, found.total)
    return Mca(found, list(names), [v for v, *_ in levels], [lv for _, lv, *_ in levels], share, cramer(df, names) if associations else None)
