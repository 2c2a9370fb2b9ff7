"""One way to run any of the factor methods, and the rules of how many of their axes to keep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from multifactor.operators.correspondence import correspondence_of, mca
from multifactor.operators.mixed import famd, mfa
from multifactor.operators.pca import correlation_pca
from multifactor.operators.retention import Criterion, consensus, elbow, reaching


@dataclass(frozen=True)
class Solution:
    """A fitted method: eigenvalues, the rows' coordinates (lazily), the criteria and the axes they agree on."""

    method: str
    fitted: object
    values: np.ndarray
    total: float
    coordinates: DataFrame | None
    rules: list[Criterion]
    k: int


def axis_rules(values: np.ndarray, total: float, *, mean_axes: int | None = None, adjusted: Mapping | None = None) -> list[Criterion]:
    """Mean inertia (or MCA's 1/Q) and cumulated shares (adjusted for MCA), and the elbow from three axes on."""
    k = len(values)
    if adjusted is not None:
        shares = np.cumsum(adjusted["greenacre_share"])
        rules = [Criterion("over 1/Q", int((values > adjusted["threshold"]).sum()), 3)]
    else:
        shares = np.cumsum(values) / total if total > 0 else np.zeros(k)
        rules = [Criterion("over the mean inertia", int((values > total / (mean_axes or max(1, k))).sum()), 2)]
    rules += [Criterion("70 % of inertia", reaching(list(shares), 0.70), 1), Criterion("80 % of inertia", reaching(list(shares), 0.80), 1)]
    if k >= 3:
        rules.append(Criterion("scree elbow", elbow(list(values)), 1))
    return [Criterion(r.name, min(max(1, r.k), max(1, k)), r.weight) for r in rules]


def run(df: DataFrame, method: str, *, numeric: Sequence[str] = (), categorical: Sequence[str] = (), groups: Mapping[str, Sequence[str]] | None = None) -> Solution:
    """Run pca, ca, mca, famd or mfa on the rows complete in the variables used.

    CA needs two different categorical columns, MCA two or more, FAMD one, MFA two groups of two variables.
    """
    groups = groups or {}
    used = [*numeric, *categorical, *[v for g in groups.values() for v in g]]
    rows = df.dropna(subset=list(dict.fromkeys(used)))
    if method == "pca":
        if len(numeric) < 2:
            raise ValueError("PCA needs two numeric variables")
        f = correlation_pca(rows, list(numeric))
        values, total, coordinates = f.values, f.total, f.scores(rows)
        rules = axis_rules(values, total)
    elif method == "ca":
        if len(set(categorical)) != 2:
            raise ValueError("CA needs two different categorical variables")
        f = correspondence_of(rows, *categorical)
        values, total, coordinates = f.values, f.inertia, None
        rules = axis_rules(values, total)
    elif method == "mca":
        if len(categorical) < 2:
            raise ValueError("MCA needs two categorical variables")
        f = mca(rows, categorical)
        values, total, coordinates = f.core.values, f.raw_inertia, f.rows(rows)
        rules = axis_rules(values, total, adjusted=f.adjusted)
    elif method == "famd":
        if not categorical or not numeric:
            raise ValueError("FAMD needs a variable of each kind")
        f = famd(rows, numeric, categorical)
        values, total, coordinates = f.core.values, f.core.total, f.rows(rows)
        rules = axis_rules(values, total)
    elif method == "mfa":
        if len(groups) < 2 or any(len(g) < 2 for g in groups.values()):
            raise ValueError("MFA needs two groups of two variables each")
        f = mfa(rows, dict(groups), [n for n, g in groups.items() if all(dict(df.dtypes)[v] == "string" for v in g)])
        values, total, coordinates = f.core.values, f.core.total, f.rows(rows)
        rules = axis_rules(values, total)
    else:
        raise ValueError(f"no such method: {method}")
    return Solution(method, f, values, total, coordinates, rules, consensus(rules))
