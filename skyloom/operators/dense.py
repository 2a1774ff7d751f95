"""Batched dense solves of small systems, many pixels (or multipoles) at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of stacked symmetric systems and whether each is positive definite; 0 where not."""
    n = a.shape[-1]
    lower, ok = np.zeros_like(a), np.ones(len(a), bool)
    for j in range(n):
        d = a[:, j, j] - (lower[:, j, :j] ** 2).sum(1)
        ok &= d > 1e-12 * np.abs(a[:, j, j])
        root = np.sqrt(np.where(ok, d, 1.0))
        lower[:, j, j] = root
        for i in range(j + 1, n):
            lower[:, i, j] = (a[:, i, j] - (lower[:, i, :j] * lower[:, j, :j]).sum(1)) / root
    y = np.zeros_like(b)
    for i in range(n):
        y[:, i] = (b[:, i] - (lower[:, i, :i] * y[:, :i]).sum(1)) / lower[:, i, i]
    x = np.zeros_like(b)
    for i in range(n - 1, -1, -1):
        x[:, i] = (y[:, i] - (lower[:, i + 1 :, i] * x[:, i + 1 :]).sum(1)) / lower[:, i, i]
    return np.where(ok[:, None], x, 0.0), ok


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """LU factors in one matrix with row pivots; False for a singular matrix."""
    f, order = a.astype(float).copy(), np.arange(len(a))
    for j in range(len(f)):
        p = j + int(np.argmax(np.abs(f[j:, j])))
        if f[p, j] == 0:
            return f, order, False
        if p != j:
            f[[j, p]], order[[j, p]] = f[[p, j]], order[[p, j]]
        f[j + 1 :, j] /= f[j, j]
        f[j + 1 :, j + 1 :] -= np.outer(f[j + 1 :, j], f[j, j + 1 :])
    return f, order, True


def lu_solve(f: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b[order].astype(float)
    for i in range(len(x)):
        x[i] -= f[i, :i] @ x[:i]
    for i in range(len(x) - 1, -1, -1):
        x[i] = (x[i] - f[i, i + 1 :] @ x[i + 1 :]) / f[i, i]
    return x


def lu_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many systems by LU with pivoting, and which were solved; 0 for a singular one."""
    x, ok = np.zeros_like(b), np.zeros(len(b), bool)
    for k in range(len(b)):
        f, order, ok[k] = lu(a[k])
        if ok[k]:
            x[k] = lu_solve(f, order, b[k])
    return x, ok


def solve_rows(sums: DataFrame, key: str, n: int, method: str = "cholesky") -> DataFrame:
    """Solve the packed systems m{i}{j}, y{i} of every row; an Arrow batch at a time, no shuffle."""
    solver = {"cholesky": cholesky_solve, "lu": lu_rows}[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.stack([np.stack([pdf[f"m{min(i, j)}{max(i, j)}"].to_numpy(float) for j in range(n)], 1) for i in range(n)], 1)
            x, ok = solver(a, np.stack([pdf[f"y{i}"].to_numpy(float) for i in range(n)], 1))
            yield pd.DataFrame({key: pdf[key], **{f"c{i}": x[:, i] for i in range(n)}, "solved": ok})

    types = dict(sums.dtypes)
    return sums.mapInPandas(run, f"{key} {types[key]}, " + ", ".join(f"c{i} double" for i in range(n)) + ", solved boolean")


def floored_inverse(a: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Inverse of a symmetric matrix with its eigenvalues floored at a share of the largest."""
    w, v = np.linalg.eigh(a)
    return (v / np.maximum(w, floor * max(w.max(), 1e-300))) @ v.T


def operator_matrix(apply: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """A linear operator column by column, for checks of symmetry and condition."""
    return np.stack([apply(e) for e in np.eye(n)], 1)


def check_operator(a: np.ndarray) -> tuple[bool, float, float]:
    """Whether a matrix is symmetric, its smallest eigenvalue, its condition number."""
    w = np.linalg.eigvalsh((a + a.T) / 2)
    return bool(np.allclose(a, a.T)), float(w.min()), float(np.abs(w).max() / max(np.abs(w).min(), 1e-300))
