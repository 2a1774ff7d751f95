"""Cubic interpolation of tabulated spectra."""

from __future__ import annotations

import numpy as np


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline whose third derivative is continuous at the second and the last but one knot."""
    n = len(x)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)  # second derivatives at the knots
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    l, r = x[k + 1] - at, at - x[k]  # noqa: E741
    return (m[k] * l**3 + m[k + 1] * r**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * l + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * r


def spinning_dust(nu: np.ndarray, nu_ref: float, peak: float, table_nu: np.ndarray, table: np.ndarray, table_peak: float) -> np.ndarray:
    """Template shifted to *peak*, one at the reference, in brightness temperature; 0 outside the table."""
    shift = table_peak / peak

    def template(f: np.ndarray) -> np.ndarray:
        f = np.atleast_1d(np.asarray(f, float)) * shift
        inside = (f >= table_nu[0]) & (f <= table_nu[-1])
        return np.where(inside, np.exp(not_a_knot(np.log(table_nu), np.log(table), np.log(np.where(inside, f, table_nu[0])))), 0.0)

    return template(nu) / template(np.array([nu_ref])) * (nu_ref / np.asarray(nu, float)) ** 2
