"""Algebra of matrices as large as the number of columns, on the driver."""

from __future__ import annotations

import numpy as np


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that each one's entry of largest magnitude (the first of equals) is positive."""
    out = np.array(vectors, dtype=float)
    for j in range(out.shape[1]):
        if out[np.argmax(np.abs(out[:, j]) > np.abs(out[:, j]).max() - 1e-12), j] < 0:
            out[:, j] = -out[:, j]
    return out


def eigen_symmetric(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and their signed vectors in columns."""
    values, vectors = np.linalg.eigh((np.asarray(matrix, float) + np.asarray(matrix, float).T) / 2)
    return values[::-1].copy(), signed(vectors[:, ::-1])


def _pivots(matrix: np.ndarray) -> np.ndarray:
    """Pivots of elimination with row exchanges, and the exchanges' sign in the last entry."""
    a = np.array(matrix, dtype=float)
    n, sign, out = len(a), 1.0, []
    for j in range(n):
        k = j + int(np.argmax(np.abs(a[j:, j])))
        if k != j:
            a[[j, k]] = a[[k, j]]
            sign = -sign
        out.append(a[j, j])
        if a[j, j] != 0:
            a[j + 1 :] -= np.outer(a[j + 1 :, j] / a[j, j], a[j])
    return np.array([*out, sign])


def inverse(matrix: np.ndarray) -> np.ndarray | None:
    """The inverse, or None where a pivot is below 1e-12."""
    if (np.abs(_pivots(matrix)[:-1]) < 1e-12).any():
        return None
    return np.linalg.inv(np.asarray(matrix, float))


def determinant(matrix: np.ndarray) -> float:
    """The determinant; exactly 0 where a pivot is below 1e-14."""
    pivots = _pivots(matrix)
    return 0.0 if (np.abs(pivots[:-1]) < 1e-14).any() else float(np.prod(pivots))


def inverse_root(matrix: np.ndarray) -> np.ndarray:
    """The inverse square root of a symmetric matrix; eigenvalues are held above 1e-12."""
    values, vectors = eigen_symmetric(matrix)
    return (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T


def nearest_orthogonal(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to a square one."""
    return matrix @ inverse_root(matrix.T @ matrix)


def to_correlation(matrix: np.ndarray) -> np.ndarray:
    """A covariance matrix as correlations; pairs with a constant are 0, the diagonal is 1."""
    sd = np.sqrt(np.maximum(np.diag(matrix), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.asarray(matrix, float) / np.outer(sd, sd)
    out = np.where(np.isfinite(out), out, 0.0)
    np.fill_diagonal(out, 1.0)
    return out


def singular_from_gram(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values above 1e-10 of the largest, and the right vectors, from Z'Z."""
    values, vectors = eigen_symmetric(gram)
    kept = values > 1e-10 * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    return values[kept], vectors[:, kept]
