"""Factor analysis of mixed data, and multiple factor analysis of groups of variables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions.columns import col
from multifactor.functions.linalg import singular_from_gram
from multifactor.operators.gsvd import Gsvd, core, from_gram, indicators
from multifactor.operators.moments import gram, moments


def _numeric(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns over their population sd; a constant is an error. (The core centres them.)"""
    if not names:
        return []
    m = moments(df, names)
    for n, s in zip(names, m.sd_population, strict=True):
        if not s > 0:
            raise ValueError(f'the variable "{n}" is constant')
    return [(col(n).cast("double") - F.lit(float(a))) / F.lit(float(s)) for n, a, s in zip(names, m.mean, m.sd_population, strict=True)]


@dataclass(frozen=True)
class Famd:
    """Axes of numeric and categorical columns together."""

    core: Gsvd
    numeric: list[str]
    variables: list[str]
    variable_of: list[str]
    levels: list[str]
    share_of: np.ndarray

    @property
    def inertia(self) -> float:
        """What the total must be: numeric variables, and levels less variables."""
        return len(self.numeric) + len(self.levels) - len(self.variables)

    @property
    def correlations(self) -> np.ndarray:
        """Correlation of each numeric variable with each axis."""
        return self.core.col_coord[: len(self.numeric)]

    @property
    def barycentres(self) -> np.ndarray:
        """Mean row coordinate of each level: the column's covariance with the axis over its share's root, scaled."""
        g = self.core.col_coord[len(self.numeric) :]
        return g * np.sqrt(self.core.values) / np.sqrt(self.share_of)[:, None]

    @property
    def eta2(self) -> np.ndarray:
        """Share of each axis' variance between the levels of each categorical variable."""
        b = self.barycentres
        out = np.zeros((len(self.variables), self.core.k))
        for i, v in enumerate(self.variables):
            mine = np.array([x == v for x in self.variable_of])
            out[i] = (self.share_of[mine, None] * b[mine] ** 2).sum(0) / self.core.values
        return out

    def columns(self, spark: SparkSession) -> DataFrame:
        """(kind, variable, level, axis, coord, cos2, contribution): correlations and r2, or barycentres and their cos2."""
        c, r, b = self.core.col_contribution, self.correlations, self.barycentres
        rows = [("numeric", v, None, k + 1, float(r[j, k]), float(r[j, k] ** 2), float(c[j, k])) for j, v in enumerate(self.numeric) for k in range(self.core.k)]
        d2 = (b**2).sum(1)
        for j, (v, level) in enumerate(zip(self.variable_of, self.levels, strict=True)):
            rows += [("level", v, level, k + 1, float(b[j, k]), float(b[j, k] ** 2 / d2[j]) if d2[j] > 0 else 0.0, float(c[len(self.numeric) + j, k])) for k in range(self.core.k)]
        return spark.createDataFrame(rows, "kind string, variable string, level string, axis int, coord double, cos2 double, contribution double")

    def squared(self, spark: SparkSession) -> DataFrame:
        """(variable, axis, squared): r2 of numeric and eta2 of categorical variables."""
        table = np.vstack([self.correlations**2, self.eta2])
        return spark.createDataFrame([(v, k + 1, float(table[j, k])) for j, v in enumerate([*self.numeric, *self.variables]) for k in range(self.core.k)], "variable string, axis int, squared double")

    def rows(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """Coordinates of the rows."""
        return self.core.rows(df, k)


def famd(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], order: str = "_row") -> Famd:
    """FAMD of complete columns: standardised numbers (population sd) and indicators over the root of their share."""
    if not numeric and not categorical:
        raise ValueError("at least one variable is needed")
    levels = indicators(df, categorical, order) if categorical else []
    coded = _numeric(df, numeric) + [x / F.lit(float(np.sqrt(s))) for *_, s, x in levels]
    names = [*numeric, *[f"{v}={lv}" for v, lv, *_ in levels]]
    return Famd(core(df, names, coded), list(numeric), list(categorical), [v for v, *_ in levels], [lv for _, lv, *_ in levels], np.array([s for *_, s, _ in levels]))


@dataclass(frozen=True)
class Mfa:
    """Axes of groups of variables, each group balanced by its own first eigenvalue."""

    core: Gsvd
    groups: list[str]
    group_of: np.ndarray
    first: np.ndarray
    separate_total: np.ndarray

    @property
    def group_inertia(self) -> np.ndarray:
        """Each group's inertia on each axis, at most 1: also the groups' coordinates."""
        part = self.core.metric[:, None] * self.core.col_coord**2
        return np.array([part[self.group_of == g].sum(0) for g in range(len(self.groups))])

    @property
    def lg(self) -> np.ndarray:
        """Weighted squared covariances between groups."""
        c2 = self.core.gram**2 * np.outer(self.core.metric, self.core.metric)
        n = len(self.groups)
        return np.array([[c2[np.ix_(self.group_of == a, self.group_of == b)].sum() for b in range(n)] for a in range(n)])

    @property
    def rv(self) -> np.ndarray:
        """Lg scaled to 0..1."""
        d = np.sqrt(np.outer(np.diag(self.lg), np.diag(self.lg)))
        return np.divide(self.lg, d, out=np.zeros_like(d), where=d > 0)

    def rows(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """Coordinates of the rows."""
        return self.core.rows(df, k)

    def partial(self, df: DataFrame, k: int | None = None, keep: Sequence[str] = ("_row", "_id")) -> DataFrame:
        """(_row, group, F1, F2, ...): each row as each group sees it; a row's partial points average to its point."""
        kept, k = [c for c in keep if c in df.columns], k or self.core.k
        v = self.core.projector[:, :k]
        groups = []
        for g, name in enumerate(self.groups):
            mine = np.flatnonzero(self.group_of == g)
            fields = []
            for a in range(k):
                total = F.lit(0.0)
                for j in mine:
                    total = total + (self.core.coded[j] - F.lit(float(self.core.mean[j]))) * F.lit(float(v[j, a] * len(self.groups)))
                fields.append(total.alias(f"F{a + 1}"))
            groups.append(F.struct(F.lit(name).alias("group"), *fields))
        return df.select(*[col(c) for c in kept], F.explode(F.array(*groups)).alias("p")).select(*[col(c) for c in kept], "p.*")

    def group_table(self, spark: SparkSession) -> DataFrame:
        """(group, variables, first, weight, inertia, axis, coord)."""
        gi = self.group_inertia
        rows = [(n, int((self.group_of == g).sum()), float(self.first[g]), float(1 / self.first[g]) if self.first[g] > 0 else 0.0, float(self.separate_total[g]), k + 1, float(gi[g, k])) for g, n in enumerate(self.groups) for k in range(self.core.k)]
        return spark.createDataFrame(rows, "group string, variables int, first double, weight double, inertia double, axis int, coord double")

    def relations(self, spark: SparkSession) -> DataFrame:
        """(a, b, lg, rv) of each pair of groups."""
        lg, rv = self.lg, self.rv
        return spark.createDataFrame([(a, b, float(lg[i, j]), float(rv[i, j])) for i, a in enumerate(self.groups) for j, b in enumerate(self.groups)], "a string, b string, lg double, rv double")


def mfa(df: DataFrame, groups: dict[str, Sequence[str]], categorical: Sequence[str] = (), order: str = "_row") -> Mfa:
    """MFA of complete columns in groups; groups named in ``categorical`` are coded as in FAMD.

    One Gram job over all groups: each group's own analysis is a block of that matrix.
    """
    if not groups:
        raise ValueError("at least one group is needed")
    names: list[str] = []
    coded: list[Column] = []
    group_of: list[int] = []
    for g, (name, variables) in enumerate(groups.items()):
        if not variables:
            raise ValueError(f'the group "{name}" has no variables')
        if name in categorical:
            found = indicators(df, variables, order)
            names += [f"{v}={lv}" for v, lv, *_ in found]
            coded += [x / F.lit(float(np.sqrt(s))) for *_, s, x in found]
            group_of += [g] * len(found)
        else:
            names += list(variables)
            coded += _numeric(df, variables)
            group_of += [g] * len(variables)
    of = np.array(group_of)
    mean = np.array([v or 0.0 for v in df.agg(*[F.avg(c) for c in coded]).first()])
    g, n = gram(df, coded, mean)
    c = g / (n or 1.0)
    first, totals = np.zeros(len(groups)), np.zeros(len(groups))
    for i in range(len(groups)):
        values = singular_from_gram(c[np.ix_(of == i, of == i)])[0]
        first[i], totals[i] = values[0] if len(values) else 0.0, values.sum()
    weight = np.where(first > 0, 1 / np.where(first > 0, first, 1.0), 0.0)
    return Mfa(from_gram(names, coded, mean, c, weight[of]), list(groups), of, first, totals)
