"""Rotation of loadings (p x k, on the driver): gradient projection, promax, and simple-structure figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from multifactor.functions.linalg import inverse, nearest_orthogonal

ITERATIONS, PRECISION, HALVINGS = 1500, 1e-7, 12
ORTHOGONAL = ("varimax", "quartimax", "equamax", "parsimax")
OBLIQUE = ("quartimin", "oblimin", "promax")
METHODS = ("none", *ORTHOGONAL, *OBLIQUE)

Criterion = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Rotation:
    """pattern = loadings T (orthogonal); structure = pattern phi."""

    method: str
    pattern: np.ndarray
    structure: np.ndarray
    phi: np.ndarray
    transform: np.ndarray
    oblique: bool
    converged: bool
    iterations: int

    @property
    def ss(self) -> np.ndarray:
        """Sum of squared loadings of each axis."""
        return (self.pattern**2).sum(0)


def orthomax(gamma: float) -> Criterion:
    """Value and gradient of the orthomax family: 0 quartimax, 1 varimax."""

    def at(loadings: np.ndarray) -> tuple[float, np.ndarray]:
        squares = loadings**2
        spread = squares - gamma * squares.mean(0)
        return -float((squares * spread).sum()) / 4, -loadings * spread

    return at


def oblimin(gamma: float) -> Criterion:
    """Value and gradient of direct oblimin: 0 quartimin."""

    def at(loadings: np.ndarray) -> tuple[float, np.ndarray]:
        squares = loadings**2
        others = squares.sum(1, keepdims=True) - squares
        others = others - gamma * others.mean(0)
        return float((squares * others).sum()) / 4, loadings * others

    return at


def _descend(start: np.ndarray, at, project, retract, stop_if_stuck: bool):
    """Projected gradient steps: the length doubles each time and is halved until the value falls enough.

    ``at(T)``: value, gradient by T and loadings, or None where T is singular.
    """
    t, length = start, 1.0
    value, gradient, loadings = at(t)
    for i in range(ITERATIONS):
        direction = project(t, gradient)
        size = float(np.linalg.norm(direction))
        if size < PRECISION:
            return t, loadings, True, i
        length *= 2
        for _ in range(HALVINGS):
            new = retract(t - length * direction)
            tried = at(new)
            if tried is not None and tried[0] < value - size * size * length / 2:
                t, (value, gradient, loadings) = new, tried
                break
            length /= 2
        else:
            if stop_if_stuck:
                return t, loadings, False, i
    return t, loadings, False, ITERATIONS


def rotate_orthogonal(a: np.ndarray, criterion: Criterion):
    """Loadings, T, phi, converged and iterations of an orthogonal gradient projection."""

    def at(t):
        value, by_loadings = criterion(a @ t)
        return value, a.T @ by_loadings, a @ t

    def tangent(t, g):
        m = t.T @ g
        return g - t @ (m + m.T) / 2

    t, loadings, converged, steps = _descend(np.eye(a.shape[1]), at, tangent, nearest_orthogonal, False)
    return loadings, t, np.eye(a.shape[1]), converged, steps


def rotate_oblique(a: np.ndarray, criterion: Criterion):
    """The same with unit-length columns of T and correlated axes."""

    def at(t):
        back = inverse(t)
        if back is None:
            return None
        loadings = a @ back.T
        value, by_loadings = criterion(loadings)
        return value, -(loadings.T @ by_loadings @ back).T, loadings

    unit = lambda t: t / np.maximum(np.linalg.norm(t, axis=0), 1e-12)
    t, loadings, converged, steps = _descend(np.eye(a.shape[1]), at, lambda t, g: g - t * (t * g).sum(0), unit, True)
    return loadings, t, _correlation(t.T @ t), converged, steps


def _correlation(m: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(m))
    return m / np.outer(d, d)


def promax(a: np.ndarray, kappa: float = 4):
    """Varimax loadings turned towards their own powers, by least squares; axes may then be correlated.

    The powers are regressed on the loadings, and the coefficients' columns are scaled so that axes have unit variance.
    With the coefficients' triangular factor R, the inverse of R times its transpose holds the axes' covariances: its
    diagonal gives the scales, and scaled by them it is Phi. Where loadings or coefficients are of lower rank, that is
    where R has a diagonal entry under 1e-10 of its largest, varimax is returned.
    """
    first = rotate_orthogonal(a, orthomax(1))
    x, t = first[0], first[1]
    k = x.shape[1]
    coefficients, _, rank, _ = np.linalg.lstsq(x, np.sign(x) * np.abs(x) ** kappa, rcond=1e-10)
    r = np.linalg.qr(coefficients, mode="r")
    edge = np.abs(np.diag(r))
    if rank < k or edge.min() <= 1e-10 * edge.max():
        return first
    undo = np.linalg.solve(r, np.eye(k))
    covariance = undo @ undo.T
    scale = np.sqrt(np.diag(covariance))
    return x @ (coefficients * scale), t @ (coefficients * scale), covariance / np.outer(scale, scale), True, first[4]


def rotate(loadings: np.ndarray, method: str = "varimax", *, normalize: bool = True, delta: float = 0.0, kappa: float = 4.0) -> Rotation:
    """Rotate loadings; axes are turned to a positive sum of v|v| and ordered by their sum of squares.

    ``normalize`` rotates rows of unit length (Kaiser) and gives them their length back.
    """
    if method not in METHODS:
        raise ValueError(f"no such rotation: {method}")
    a = np.asarray(loadings, float)
    p, k = a.shape
    if method == "none" or k < 2:
        return Rotation(method, a.copy(), a.copy(), np.eye(k), np.eye(k), False, True, 0)
    length = np.linalg.norm(a, axis=1, keepdims=True)
    length[length == 0] = 1e-12
    unit = a / length if normalize else a
    gamma = {"varimax": 1.0, "quartimax": 0.0, "equamax": k / 2, "parsimax": p * (k - 1) / (p + k - 2)}
    if method in gamma:
        found = rotate_orthogonal(unit, orthomax(gamma[method]))
    elif method == "promax":
        found = promax(unit, kappa)
    else:
        found = rotate_oblique(unit, oblimin(delta if method == "oblimin" else 0.0))
    pattern, t, phi, converged, steps = found
    pattern = pattern * length if normalize else pattern
    turn = np.where((pattern * np.abs(pattern)).sum(0) < 0, -1.0, 1.0)
    order = np.argsort(-((pattern * turn) ** 2).sum(0), kind="stable")
    pattern, t, phi = (pattern * turn)[:, order], (t * turn)[:, order], (phi * np.outer(turn, turn))[np.ix_(order, order)]
    oblique = method in OBLIQUE
    return Rotation(method, pattern, pattern @ phi if oblique else pattern.copy(), phi, t, oblique, converged, steps)


def diagnostics(spark: SparkSession, rotation: Rotation, names: list[str], threshold: float = 0.4) -> DataFrame:
    """(variable, communality, complexity, axis, over, kind): kind is clean, cross or none by loadings of ``threshold``."""
    a = rotation.pattern
    communality = ((a @ rotation.phi) * a).sum(1) if rotation.oblique else (a**2).sum(1)
    rows = []
    for name, line, h in zip(names, a, communality, strict=True):
        s4 = float((line**4).sum())
        over = int((np.abs(line) >= threshold).sum())
        rows.append((name, float(h), float((line**2).sum() ** 2 / s4) if s4 > 0 else 0.0, int(np.argmax(np.abs(line))) + 1, over, ("none", "clean")[over] if over < 2 else "cross"))
    return spark.createDataFrame(rows, "variable string, communality double, complexity double, axis int, over int, kind string")


def variance_table(spark: SparkSession, before: np.ndarray, rotation: Rotation, total: float) -> DataFrame:
    """(axis, before, after, share_before, share_after, cumulative_after) of the rotated axes."""
    after = rotation.ss
    rows = [(i + 1, float(b), float(s), float(b / total), float(s / total), float(after[: i + 1].sum() / total)) for i, (b, s) in enumerate(zip(before, after, strict=False))]
    return spark.createDataFrame(rows, "axis int, before double, after double, share_before double, share_after double, cumulative_after double")


def thurstone(r: np.ndarray, structure: np.ndarray) -> np.ndarray | None:
    """Regression weights of scores on standardised variables; None if the correlations are singular."""
    inv = inverse(r)
    return None if inv is None else inv @ structure


def pattern_table(spark: SparkSession, rotation: Rotation, names: list[str]) -> DataFrame:
    """(variable, axis, pattern, structure) in long form."""
    rows = [(v, k + 1, float(rotation.pattern[j, k]), float(rotation.structure[j, k])) for j, v in enumerate(names) for k in range(rotation.pattern.shape[1])]
    return spark.createDataFrame(rows, "variable string, axis int, pattern double, structure double")


def phi_table(spark: SparkSession, rotation: Rotation) -> DataFrame:
    """(axis, other, r): correlations of the rotated axes."""
    k = len(rotation.phi)
    return spark.createDataFrame([(i + 1, j + 1, float(rotation.phi[i, j])) for i in range(k) for j in range(k)], "axis int, other int, r double")
