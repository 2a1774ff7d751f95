"""Spherical harmonics of spin 0 and 2 on RING maps.

Coefficients are a complex array indexed by (l, m) pairs with m >= 0, m-major as listed by
``pairs``.  A transform is two steps: for each m a sum over l with functions of the ring's
colatitude, which a three-term recurrence in l gives, and for each ring a Fourier transform over m.
The numpy functions do both on one machine; ``synthesis_table`` and ``adjoint_table`` are the
same steps as two grouped stages of a DataFrame, one group for each m and one for each ring, so a
map of any resolution is spread over the cluster.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(lmax: int) -> list[tuple[int, int]]:
    return [(ell, m) for m in range(lmax + 1) for ell in range(m, lmax + 1)]


def nalm(lmax: int) -> int:
    return (lmax + 1) * (lmax + 2) // 2


def place(ell: int, m: int, lmax: int) -> int:
    """Index of (l, m) in the order of ``pairs``."""
    return m * (lmax + 1) - m * (m - 1) // 2 + ell - m


@lru_cache(maxsize=16)
def rings(nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Colatitude, number of pixels, longitude of the first one and first pixel of every ring."""
    ring = np.arange(1, 4 * nside)
    north = np.minimum(ring, 4 * nside - ring)
    cap = north < nside
    n = 4 * np.where(cap, north, nside)
    z = np.where(cap, 1 - north**2 / (3 * nside**2), 4 / 3 - 2 * ring / (3 * nside))
    z = np.where(cap & (ring > 2 * nside), -z, z)
    shift = np.where(cap | ((ring - nside) % 2 == 0), 0.5, 0.0)
    return np.arccos(z), n, shift * 2 * pi / n, np.concatenate([[0], np.cumsum(n)[:-1]])


def directions(nside: int) -> tuple[np.ndarray, np.ndarray]:
    """(theta, phi) of all pixel centres in RING order."""
    theta, n, phi0, _ = rings(nside)
    phi = np.concatenate([p + np.arange(k) * 2 * pi / k for p, k in zip(phi0, n, strict=True)])
    return np.repeat(theta, n), phi


def wigner_d(lmax: int, m: int, s: int, theta: np.ndarray) -> np.ndarray:
    """d^l_{m s}(theta) for l = m .. lmax (rows; zeros below |s|), m >= 0, by the recurrence in l.

    Values are carried with a logarithmic scale of their own, since those of large m near a pole
    are below the least double.
    """
    out = np.zeros((lmax - m + 1, len(theta)))
    first = max(m, abs(s))
    if first > lmax:
        return out
    c, n = np.cos(theta / 2), np.sin(theta / 2)
    # at the first l, d is one product of powers of cosine and sine
    up, down = abs(m + s), abs(m - s)
    sign = 1 if s > m else (-1) ** (m - s)
    scale = 0.5 * (lgamma(2 * first + 1) - lgamma(up + 1) - lgamma(down + 1))
    with np.errstate(divide="ignore"):
        level = scale + up * np.log(c) + down * np.log(n)
    before, now = np.zeros(len(theta)), np.full(len(theta), float(sign))
    x = np.cos(theta)
    for ell in range(first, lmax + 1):
        out[ell - m] = now * np.exp(level)
        if ell == lmax:
            break
        a = sqrt(((ell + 1) ** 2 - m * m) * ((ell + 1) ** 2 - s * s))
        b = sqrt(max(0, (ell * ell - m * m) * (ell * ell - s * s)))
        if ell == 0:
            after = x * now
        else:
            after = ((2 * ell + 1) * (ell * (ell + 1) * x - m * s) * now - (ell + 1) * b * before) / (ell * a)
        before, now = now, after
        large = np.abs(now) > 1e100
        if large.any():
            before, now, level = np.where(large, before * 1e-100, before), np.where(large, now * 1e-100, now), np.where(large, level + 100 * log(10), level)
    return out


#: Degrees up to which the functions of colatitude are kept between transforms.
KEPT = 64
_KEPT: dict[tuple, tuple[np.ndarray, ...]] = {}


def lambdas(lmax: int, m: int, theta: np.ndarray, spin: int) -> tuple[np.ndarray, ...]:
    """Functions of colatitude of the harmonics for l = m .. lmax: one for spin 0; for spin 2 half the
    sum and half the difference of those of spin 2 and -2."""
    if lmax > KEPT:
        return _lambdas(lmax, m, theta, spin)
    key = (lmax, m, spin, theta.tobytes())
    if key not in _KEPT:
        if len(_KEPT) > 1024:
            _KEPT.clear()
        _KEPT[key] = _lambdas(lmax, m, theta, spin)
    return _KEPT[key]


def _lambdas(lmax: int, m: int, theta: np.ndarray, spin: int) -> tuple[np.ndarray, ...]:
    norm = np.sqrt((2 * np.arange(m, lmax + 1) + 1) / (4 * pi))[:, None]
    if not spin:
        return (norm * wigner_d(lmax, m, 0, theta),)
    plus, minus = norm * wigner_d(lmax, m, -2, theta), norm * wigner_d(lmax, m, 2, theta)
    return (plus + minus) / 2, (plus - minus) / 2


def legendre(alm: list[np.ndarray], m: int, lmax: int, theta: np.ndarray, spin: int) -> list[np.ndarray]:
    """The fields' m-th Fourier coefficients on every ring from their coefficients of one m (l = m .. lmax)."""
    lam = lambdas(lmax, m, theta, spin)
    if not spin:
        return [alm[0] @ lam[0]]
    e, b = alm
    return [-(e @ lam[0] + 1j * (b @ lam[1])), -(b @ lam[0] - 1j * (e @ lam[1]))]


def legendre_adjoint(modes: list[np.ndarray], m: int, lmax: int, theta: np.ndarray, spin: int) -> list[np.ndarray]:
    """Coefficients of one m from the fields' m-th Fourier sums on every ring."""
    lam = lambdas(lmax, m, theta, spin)
    if not spin:
        return [lam[0] @ modes[0]]
    q, u = modes
    return [-(lam[0] @ q) - 1j * (lam[1] @ u), -(lam[0] @ u) + 1j * (lam[1] @ q)]


def ring_values(modes: np.ndarray, n: int, phi0: float) -> np.ndarray:
    """Real pixels of a ring from its modes m = 0 .. mmax; modes beyond the ring's sampling alias."""
    m = np.arange(len(modes))
    turned = modes * np.exp(1j * m * phi0) * np.where(m > 0, 2.0, 1.0)
    folded = np.bincount(m % n, turned.real, n) + 1j * np.bincount(m % n, turned.imag, n)
    return (np.fft.ifft(folded) * n).real


def ring_modes(values: np.ndarray, mmax: int, phi0: float) -> np.ndarray:
    """Fourier sums of a ring's pixels for m = 0 .. mmax."""
    m = np.arange(mmax + 1)
    return np.fft.fft(values)[m % len(values)] * np.exp(-1j * m * phi0)


def _synthesis(fields: list[np.ndarray], nside: int, lmax: int, spin: int) -> list[np.ndarray]:
    theta, n, phi0, first = rings(nside)
    modes = np.zeros((len(fields), lmax + 1, len(theta)), complex)
    for m in range(lmax + 1):
        at = place(m, m, lmax)
        modes[:, m] = legendre([f[at : at + lmax - m + 1] for f in fields], m, lmax, theta, spin)
    out = [np.empty(12 * nside**2) for _ in fields]
    for r in range(len(theta)):
        for k, o in enumerate(out):
            o[first[r] : first[r] + n[r]] = ring_values(modes[k, :, r], int(n[r]), phi0[r])
    return out


def _adjoint(maps: list[np.ndarray], nside: int, lmax: int, spin: int) -> list[np.ndarray]:
    theta, n, phi0, first = rings(nside)
    modes = np.stack([np.stack([ring_modes(x[first[r] : first[r] + n[r]], lmax, phi0[r]) for r in range(len(theta))], 1) for x in maps])
    out = [np.zeros(nalm(lmax), complex) for _ in maps]
    for m in range(lmax + 1):
        at = place(m, m, lmax)
        for o, a in zip(out, legendre_adjoint(list(modes[:, m]), m, lmax, theta, spin), strict=True):
            o[at : at + lmax - m + 1] = a
    return out


@lru_cache(maxsize=64)
def _weights(lmax: int) -> np.ndarray:
    return np.array([1.0 if m == 0 else 2.0 for _, m in pairs(lmax)])


def synthesis(alm: np.ndarray, nside: int, lmax: int) -> np.ndarray:
    """Real map of coefficients."""
    return _synthesis([alm], nside, lmax, 0)[0]


def adjoint(values: np.ndarray, nside: int, lmax: int) -> np.ndarray:
    """Y^T of a map, adjoint of ``synthesis`` under the alm dot product."""
    return _adjoint([values], nside, lmax, 0)[0]


def analysis(values: np.ndarray, nside: int, lmax: int) -> np.ndarray:
    """Adjoint times the pixel area."""
    return adjoint(values, nside, lmax) * (4 * pi / len(values))


def analysis_adjoint(alm: np.ndarray, nside: int, lmax: int) -> np.ndarray:
    """Adjoint of ``analysis``: the map of the coefficients times the pixel area."""
    return synthesis(alm, nside, lmax) * (4 * pi / (12 * nside**2))


def synthesis_spin2(e: np.ndarray, b: np.ndarray, nside: int, lmax: int) -> tuple[np.ndarray, np.ndarray]:
    """(Q, U) maps of E and B coefficients."""
    q, u = _synthesis([e, b], nside, lmax, 2)
    return q, u


def adjoint_spin2(q: np.ndarray, u: np.ndarray, nside: int, lmax: int) -> tuple[np.ndarray, np.ndarray]:
    e, b = _adjoint([q, u], nside, lmax, 2)
    return e, b


def dot(a: np.ndarray, b: np.ndarray, lmax: int) -> float:
    return float(np.sum(_weights(lmax) * (a.conj() * b).real))


def _least_squares(maps: list[np.ndarray], nside: int, lmax: int, spin: int, tolerance: float, most: int) -> list[np.ndarray]:
    r = np.stack(_adjoint(maps, nside, lmax, spin))
    x = np.zeros_like(r)
    product = lambda a, b: sum(dot(p, q, lmax) for p, q in zip(a, b, strict=True))
    p, rr = r, product(r, r)
    first = rr
    for _ in range(most):
        if rr <= tolerance**2 * first or not rr:
            break
        q = np.stack(_adjoint(_synthesis(list(p), nside, lmax, spin), nside, lmax, spin))
        a = rr / product(p, q)
        x, r = x + a * p, r - a * q
        new = product(r, r)
        p, rr = r + new / rr * p, new
    return list(x)


def least_squares(values: np.ndarray, nside: int, lmax: int, tolerance: float = 1e-12, most: int = 200) -> np.ndarray:
    """Coefficients whose map is closest to *values*, by conjugate gradients on the normal equations."""
    return _least_squares([values], nside, lmax, 0, tolerance, most)[0]


def least_squares_spin2(q: np.ndarray, u: np.ndarray, nside: int, lmax: int, tolerance: float = 1e-12, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """E and B coefficients whose maps are closest to Q and U; those below l = 2 are zero."""
    e, b = _least_squares([q, u], nside, lmax, 2, tolerance, most)
    return e, b


#: Groups that the keys of a table are spread over for each m and each ring.
SPREAD = 32


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)) if keys else F.lit(0).cast("long"))


def _numbered(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """The number of each row's key in the group, and the keys in that order."""
    if not keys:
        return np.zeros(len(pdf), int), pd.DataFrame(index=[0])
    grouped = pdf.groupby(keys, sort=True, dropna=False)
    return grouped.ngroup().to_numpy(), grouped.first().index.to_frame(index=False)


def _listed(names: pd.DataFrame, each: dict[str, np.ndarray], blocks: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows for each key and place: *each* has a value a place, *blocks* one a key and place."""
    places = len(next(iter(each.values())))
    out = {k: np.repeat(names[k].to_numpy(), places) for k in names.columns}
    return pd.DataFrame(out | {k: np.tile(v, len(names)) for k, v in each.items()} | {k: v.ravel() for k, v in blocks.items()})


def synthesis_table(alm: DataFrame, keys: list[str], nside: int, lmax: int, fields: tuple[str, ...] = ("a",), out: tuple[str, ...] = ("value",)) -> DataFrame:
    """keys, pix and the real maps of coefficients in rows (keys, l, m, {field}_re, {field}_im): one
    field of spin 0, or E and B of spin 2, for Q and U.

    The stage between holds one row for each key, m and ring; coefficients that a key lacks are 0.
    A group is one m, or one ring, of a share of the keys.
    """
    theta, n, phi0, first = rings(nside)
    spin, types = 0 if len(fields) == 1 else 2, dict(alm.dtypes)
    head = "".join(f"{k} {types[k]}, " for k in keys)

    def by_m(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        at, names = _numbered(pdf, keys)
        coefficients = [np.zeros((len(names), lmax - m + 1), complex) for _ in fields]
        for c, f in zip(coefficients, fields, strict=True):
            np.add.at(c, (at, pdf["l"].to_numpy() - m), pdf[f"{f}_re"].to_numpy() + 1j * pdf[f"{f}_im"].to_numpy())
        got = legendre(coefficients, m, lmax, theta, spin)
        blocks = {f"{p}{k}": v for k, g in enumerate(got) for p, v in (("re", g.real), ("im", g.imag))}
        return _listed(names, {"m": np.full(len(theta), m), "ring": np.arange(len(theta))}, blocks).assign(_part=pdf["_part"].iloc[0])

    def by_ring(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["ring"].iloc[0])
        at, names = _numbered(pdf, keys)
        blocks = {}
        for k, o in enumerate(out):
            modes = np.zeros((len(names), lmax + 1), complex)
            modes[at, pdf["m"].to_numpy()] = pdf[f"re{k}"].to_numpy() + 1j * pdf[f"im{k}"].to_numpy()
            blocks[o] = np.stack([ring_values(x, int(n[r]), phi0[r]) for x in modes])
        return _listed(names, {"pix": first[r] + np.arange(n[r])}, blocks)

    middle = head + "m int, ring int, " + "".join(f"re{k} double, im{k} double, " for k in range(len(fields))) + "_part long"
    wanted = _spread(alm.where(f"l <= {lmax}").select(*keys, "l", "m", *(f"{f}_{p}" for f in fields for p in ("re", "im"))), keys)
    modes = wanted.groupBy("_part", "m").applyInPandas(by_m, middle)
    return modes.groupBy("_part", "ring").applyInPandas(by_ring, head + "pix long, " + ", ".join(f"{o} double" for o in out))


def adjoint_table(maps: DataFrame, keys: list[str], nside: int, lmax: int, values: tuple[str, ...] = ("value",), fields: tuple[str, ...] = ("a",)) -> DataFrame:
    """keys, l, m, {field}_re, {field}_im: the adjoint of ``synthesis_table``; pixels that a key lacks are 0."""
    theta, n, phi0, first = rings(nside)
    spin, types = 0 if len(values) == 1 else 2, dict(maps.dtypes)
    head = "".join(f"{k} {types[k]}, " for k in keys)

    def by_ring(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["_ring"].iloc[0])
        at, names = _numbered(pdf, keys)
        blocks = {}
        for k, v in enumerate(values):
            x = np.zeros((len(names), n[r]))
            x[at, pdf["pix"].to_numpy() - first[r]] = pdf[v].to_numpy()
            modes = np.stack([ring_modes(row, lmax, phi0[r]) for row in x])
            blocks |= {f"re{k}": modes.real, f"im{k}": modes.imag}
        return _listed(names, {"ring": np.full(lmax + 1, r), "m": np.arange(lmax + 1)}, blocks).assign(_part=pdf["_part"].iloc[0])

    def by_m(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        at, names = _numbered(pdf, keys)
        modes = [np.zeros((len(theta), len(names)), complex) for _ in values]
        for k, x in enumerate(modes):
            x[pdf["ring"].to_numpy(), at] = pdf[f"re{k}"].to_numpy() + 1j * pdf[f"im{k}"].to_numpy()
        got = legendre_adjoint(modes, m, lmax, theta, spin)
        blocks = {f"{f}_{p}": v for f, g in zip(fields, got, strict=True) for p, v in (("re", g.real.T), ("im", g.imag.T))}
        return _listed(names, {"l": np.arange(m, lmax + 1), "m": np.full(lmax - m + 1, m)}, blocks)

    # the ring of a pixel: a cap's from the pixel's number, a belt's by division
    pix, cap, npix = F.col("pix"), 2 * nside * (nside - 1), 12 * nside**2
    north = F.floor((F.sqrt(pix * 2.0 + 1.0) + 1.0) / 2.0)
    south = F.lit(4 * nside) - F.floor((F.sqrt((F.lit(npix) - pix) * 2.0 - 1.0) + 1.0) / 2.0)
    ring = F.when(pix < cap, north).when(pix < npix - cap, F.floor((pix - cap) / (4 * nside)) + nside).otherwise(south) - 1
    with_ring = _spread(maps.select(*keys, "pix", *values).withColumn("_ring", ring.cast("int")), keys)
    middle = head + "ring int, m int, " + "".join(f"re{k} double, im{k} double, " for k in range(len(values))) + "_part long"
    modes = with_ring.groupBy("_part", "_ring").applyInPandas(by_ring, middle)
    return modes.groupBy("_part", "m").applyInPandas(by_m, head + "l int, m int, " + ", ".join(f"{f}_re double, {f}_im double" for f in fields))


def smooth(values: np.ndarray, rms: np.ndarray, nside: int, lmax: int, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Noise-weighted smoothing: smooth(d / s^2) / smooth(1 / s^2) and its rms; 0 and inf where unobserved."""
    w = np.where(np.isfinite(rms) & (rms > 0), 1 / np.where(rms > 0, rms, 1.0) ** 2, 0.0)
    fl = np.array([window[ell] for ell, _ in pairs(lmax)])
    both = [synthesis(least_squares(x, nside, lmax) * fl, nside, lmax) for x in (np.where(w > 0, values, 0.0) * w, w)]
    seen = both[1] > 0
    safe = np.where(seen, both[1], 1.0)
    return np.where(seen, both[0] / safe, 0.0), np.where(seen, 1 / np.sqrt(safe), np.inf)


def gaussian_window(lmax: int, fwhm_arcmin: float) -> np.ndarray:
    ell = np.arange(lmax + 1)
    return np.exp(-0.5 * ell * (ell + 1) * (fwhm_arcmin * pi / 180 / 60) ** 2 / (8 * np.log(2)))


def smooth_to(values: np.ndarray, nside: int, lmax: int, fwhm: float, target: float) -> np.ndarray:
    """Smooth a map of resolution *fwhm* to *target* (arcmin); an equal or finer target changes nothing."""
    if target <= fwhm:
        return values
    fl = gaussian_window(lmax, sqrt(target**2 - fwhm**2))
    return synthesis(least_squares(values, nside, lmax) * fl[[ell for ell, _ in pairs(lmax)]], nside, lmax)


def random_alm(cl: np.ndarray, spin: int, rng: np.random.Generator) -> np.ndarray:
    """Gaussian coefficients of a spectrum; none below the spin, real at m = 0."""
    lm = pairs(len(cl) - 1)
    x = (rng.standard_normal(len(lm)) + 1j * rng.standard_normal(len(lm))) / sqrt(2)
    x = np.array([v.real * sqrt(2) if m == 0 else v for v, (_, m) in zip(x, lm, strict=True)], complex)
    return x * np.array([sqrt(cl[ell]) if ell >= spin else 0.0 for ell, _ in lm])


def band_sky(amplitude: np.ndarray, sed: float, nside: int, lmax: int, fwhm: float, band_fwhm: float) -> np.ndarray:
    """A diffuse component in a band: amplitude times spectrum, smoothed by what the amplitude lacks."""
    return smooth_to(amplitude, nside, lmax, fwhm, band_fwhm) * sed
