"""Fourier-domain operators on scans and noise sampling, one detector-scan a group.

A group is one detector-scan, whose length the instrument bounds; the functions on arrays
are plain numpy and are what the grouped operators apply.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def rfft_mirrored(x: np.ndarray) -> np.ndarray:
    """Transform of the signal followed by its mirror image, so that it has no step at the ends."""
    return np.fft.rfft(np.concatenate([x, x[::-1]]))


def irfft_mirrored(f: np.ndarray, n: int) -> np.ndarray:
    return np.fft.irfft(f, 2 * n)[:n]


def oof(f: np.ndarray, sigma0: float, fknee: float, alpha: float, white: bool = True) -> np.ndarray:
    """1/f noise spectrum with or without its white part."""
    safe = np.where(f > 0, f, 1.0)
    corr = np.where(f > 0, sigma0**2 * (safe / fknee) ** alpha, 0.0)
    return corr + sigma0**2 if white else corr


def inverse_noise(x: np.ndarray, fsamp: float, psd: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """N^-1 x with the mean projected out."""
    n = len(x)
    f = np.fft.rfftfreq(2 * n, 1 / fsamp)
    spectrum = rfft_mirrored(x - x.mean()) / psd(f)
    spectrum[0] = 0
    return irfft_mirrored(spectrum, n)


def transfer(x: np.ndarray, fsamp: float, response: Callable[[np.ndarray], np.ndarray], adjoint: bool = False) -> np.ndarray:
    """Filter by a response of frequency; the adjoint pads with zeros, conjugates and folds."""
    n = len(x)
    h = response(np.fft.rfftfreq(2 * n, 1 / fsamp))
    if not adjoint:
        return irfft_mirrored(h * rfft_mirrored(x), n)
    y = np.fft.irfft(np.conj(h) * np.fft.rfft(np.concatenate([x, np.zeros(n)])), 2 * n)
    return y[:n] + y[n:][::-1]


def periodogram(x: np.ndarray, fsamp: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided |X|^2 / n."""
    return np.fft.rfftfreq(len(x), 1 / fsamp), np.abs(np.fft.rfft(x)) ** 2 / len(x)


def binned(f: np.ndarray, p: np.ndarray, nbin: int, unit: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Means of a spectrum in exponential bins over f > 0; NaN in empty bins.

    *f* may count a frequency of 1 / *unit*: sums of whole numbers are exact, so a mean is rounded once.
    """
    edges = np.geomspace(f[1], f[-1] * (1 + 1e-9), nbin + 1) if len(f) > 2 else np.linspace(0, unit, nbin + 1)
    at = np.digitize(f, edges) - 1
    ok = (at >= 0) & (at < nbin) & (f > 0)
    n = np.bincount(at[ok], minlength=nbin)
    with np.errstate(invalid="ignore"):
        return np.bincount(at[ok], f[ok], nbin) / (n * unit), np.bincount(at[ok], p[ok], nbin) / n


def sigma_of_psd(x: np.ndarray, fsamp: float, width: float, safety: float = 0.95) -> float:
    """Noise level from the lowest mean of the mirrored periodogram in bins of *width* Hz."""
    n = len(x)
    f = np.fft.rfftfreq(2 * n, 1 / fsamp)[1:-1]
    p = (np.abs(rfft_mirrored(x)) ** 2 / (2 * n))[1:-1]
    at = np.floor(f / width).astype(int)
    count = np.bincount(at)
    means = np.bincount(at, p)[count > 0] / count[count > 0]
    return float(np.sqrt(means.min()) * safety)


def conjugate_gradient(
    apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, condition: Callable[[np.ndarray], np.ndarray] | None = None, tolerance: float = 1e-10, most: int = 200, x0: np.ndarray | None = None
) -> tuple[np.ndarray, int]:
    """Preconditioned conjugate gradients; stops when r M r has fallen by *tolerance* squared."""
    condition = condition or (lambda v: v)
    x = np.zeros_like(b) if x0 is None else x0.copy()
    r = b - apply(x)
    z = condition(r)
    p, rz = z, float(np.vdot(r, z).real)
    first = rz
    for k in range(most):
        if rz <= tolerance**2 * first or not rz:
            return x, k
        q = apply(p)
        a = rz / float(np.vdot(p, q).real)
        x, r = x + a * p, r - a * q
        z = condition(r)
        new = float(np.vdot(r, z).real)
        p, rz = z + new / rz * p, new
    return x, most


def invert_cdf(log_p: np.ndarray, grid: np.ndarray, u: float) -> float:
    """Grid inversion sampler with linear interpolation of the distribution."""
    c = np.cumsum(np.exp(log_p - log_p.max()))
    return float(np.interp(u, c / c[-1], grid))


def temporal_gain(a: np.ndarray, b: np.ndarray, prior: np.ndarray, tolerance: float = 1e-10, most: int = 200) -> np.ndarray:
    """(G^-1 + diag a) delta = b for a detector's scans in order, the mean removed; 0 for one scan.

    *prior* is the power spectrum of G over the transform's frequencies; the zero mode is free.
    """
    n = len(a)
    if n < 2:
        return np.zeros(n)
    inv = np.where(prior > 0, 1 / np.where(prior > 0, prior, 1.0), 0.0)
    apply = lambda v: np.fft.irfft(inv * np.fft.rfft(v), n) + a * v
    x, _ = conjugate_gradient(apply, b, None, tolerance, most)
    return x - x.mean()


def over_scans(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply *f* to each detector-scan, its samples in order of ``i``."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: f(pdf.sort_values("i", kind="stable")), schema)


def scan_values(df: DataFrame, keys: list[str], value: str, f: Callable[[np.ndarray], np.ndarray], out: str = "value") -> DataFrame:
    """keys, i and the transformed values of every detector-scan."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[*keys, "i"]].assign(**{out: f(pdf[value].to_numpy(float))})

    types = dict(df.dtypes)
    return over_scans(df, keys, run, ", ".join([*(f"{k} {types[k]}" for k in keys), "i long", f"{out} double"]))


def scan_spectra(df: DataFrame, keys: list[str], value: str, fsamp: float, nbin: int) -> DataFrame:
    """keys, bin, f, power of every detector-scan's binned periodogram."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, p = periodogram(pdf[value].to_numpy(float), fsamp)
        f, p = binned(np.arange(len(p), dtype=float), p, nbin, len(pdf) / fsamp)
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"bin": np.arange(nbin), "f": f, "power": p})

    types = dict(df.dtypes)
    return over_scans(df, keys, run, ", ".join([*(f"{k} {types[k]}" for k in keys), "bin long", "f double", "power double"]))
