"""Draws of correlated noise on scans with gaps, and of the parameters of its spectrum."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from skyloom.operators.fourier import conjugate_gradient, invert_cdf, irfft_mirrored, oof, rfft_mirrored, sigma_of_psd


@dataclass(frozen=True)
class Draw:
    """A realisation and how it was found."""

    noise: np.ndarray
    iterations: int
    converged: bool


def _filter(x: np.ndarray, spectrum: np.ndarray) -> np.ndarray:
    return irfft_mirrored(spectrum * rfft_mirrored(x), len(x))


def constrained_noise(x: np.ndarray, mask: np.ndarray, sigma0: float, inverse: np.ndarray, white: np.ndarray | None = None, prior: np.ndarray | None = None, tolerance: float = 1e-6, most: int = 100) -> Draw:
    """Solve (C^-1 + M / sigma0^2) n = M x / sigma0^2 + draws for noise with the inverse spectrum
    *inverse* (over the frequencies of the mirrored scan), *mask* telling the valid samples.

    With the operator of a scan without gaps, which is diagonal in Fourier space, a correction
    is unknown at the gaps alone, and conjugate gradients run on these samples only.  *white* and
    *prior* are unit draws a sample; without them the result is the mean.  It stops when the
    residual is below *tolerance* times the spread of the gaps' right-hand side and their number.
    """
    weight = mask / sigma0**2
    b = weight * x
    if white is not None:
        b = b + np.sqrt(weight) * white
    if prior is not None:
        b = b + _filter(prior, np.sqrt(inverse))
    whole = 1.0 / (1.0 / sigma0**2 + inverse)
    base, gap = _filter(b, whole), ~mask.astype(bool)
    if not gap.any():
        return Draw(base, 0, True)

    def spread(v: np.ndarray) -> np.ndarray:
        full = np.zeros(len(x))
        full[gap] = v
        return full

    apply = lambda v: v - _filter(spread(v), whole)[gap] / sigma0**2
    right = base[gap] / sigma0**2
    level = right.std() if len(right) > 1 else np.std(x / sigma0**2)
    bound = tolerance * level * len(right)
    v, r = np.zeros(len(right)), right.copy()
    p, rr, k = r.copy(), float(r @ r), 0
    while np.sqrt(rr) > bound and k < most:
        q = apply(p)
        a = rr / float(p @ q)
        v, r = v + a * p, r - a * q
        new = float(r @ r)
        p, rr, k = r + new / rr * p, new, k + 1
    return Draw(base + _filter(spread(v), whole), k, bool(np.sqrt(rr) <= bound))


def full_noise(x: np.ndarray, mask: np.ndarray, sigma0: float, inverse: np.ndarray, white: np.ndarray | None = None, prior: np.ndarray | None = None, tolerance: float = 1e-10, most: int = 2000) -> np.ndarray:
    """The same by conjugate gradients on all samples, as a check."""
    weight = mask / sigma0**2
    b = weight * x + (0 if white is None else np.sqrt(weight) * white) + (0 if prior is None else _filter(prior, np.sqrt(inverse)))
    return conjugate_gradient(lambda v: _filter(v, inverse) + weight * v, b, lambda v: _filter(v, 1.0 / (inverse + 1.0 / sigma0**2)), tolerance, most)[0]


def stationary_noise(x: np.ndarray, sigma0: float, inverse: np.ndarray, white: np.ndarray | None = None, prior: np.ndarray | None = None) -> np.ndarray:
    """The draw of a scan whose gaps have been filled: one Fourier filter."""
    return constrained_noise(x, np.ones(len(x)), sigma0, inverse, white, prior).noise


def gap_noise(resid: np.ndarray, mask: np.ndarray, sigma0: float, inverse: np.ndarray, method: str, white: np.ndarray, prior: np.ndarray, most: int = 100, largest: float = 10.0) -> tuple[np.ndarray, str]:
    """Noise for the gaps of a residual: ``full_cg`` draws under the constraint of the valid samples and
    falls back to the stationary draw where that has not converged or varies *largest* times as
    much as the residual; ``fallback`` is the stationary draw at once."""
    if method not in ("full_cg", "fallback"):
        raise ValueError(f"no method {method!r}; there are full_cg and fallback")
    if method == "full_cg":
        draw = constrained_noise(resid, mask, sigma0, inverse, white, prior, most=most)
        good = mask.astype(bool)
        if draw.converged and np.var(draw.noise) <= largest * max(np.var(resid[good]) if good.any() else 0.0, sigma0**2):
            return draw.noise, "full_cg"
    return stationary_noise(resid, sigma0, inverse, white, prior), "fallback"


def log_bins(n: int, most: int = 100) -> np.ndarray:
    """Edges of at most *most* bins of exponential width, each of one mode at least."""
    edges = np.unique(np.concatenate([[0], np.ceil(np.geomspace(1, n, min(most, n) + 1)[1:]).astype(int)]))
    return edges[edges <= n]


def fitted_parameters(
    resid: np.ndarray,
    fsamp: float,
    sigma0: float,
    fknee: float,
    alpha: float,
    draws: np.ndarray,
    window: tuple[float, float] = (0.0, np.inf),
    bounds: tuple[tuple[float, float], tuple[float, float]] = ((1e-3, 10.0), (-3.0, -0.3)),
    binned: bool = False,
    grid: int = 150,
    prior: Callable[[float, float], float] | None = None,
) -> tuple[float, float]:
    """Alternating draws of knee (grid of logarithms) and slope (linear grid), sigma0 fixed; two uniforms of *draws* a sweep.

    The likelihood is that of the periodogram's modes in *window*, the mean left out; *binned*
    takes means over ``log_bins`` with their numbers of modes as weights.  Bounds are flat
    priors; *prior* is a log density of both parameters.  A scan without modes in the window keeps
    its parameters.
    """
    n = len(resid)
    f, p = np.fft.rfftfreq(n, 1 / fsamp), np.abs(np.fft.rfft(resid)) ** 2 / n
    use = (f > 0) & (f >= window[0]) & (f <= window[1])
    f, p = f[use], p[use]
    if not len(f):
        return fknee, alpha
    weight = np.ones(len(f))
    if binned:
        edges = log_bins(len(f))
        weight = np.diff(edges).astype(float)
        f, p = np.add.reduceat(f, edges[:-1]) / weight, np.add.reduceat(p, edges[:-1]) / weight
    density = prior or (lambda a, b: 0.0)

    def level(knee: float, slope: float) -> float:
        model = oof(f, sigma0, knee, slope)
        return float(-np.sum(weight * (p / model + np.log(model)))) + density(knee, slope)

    knees, slopes = np.geomspace(*bounds[0], grid), np.linspace(*bounds[1], grid)
    for one, two in draws.reshape(-1, 2):
        fknee = invert_cdf(np.array([level(k, alpha) for k in knees]), knees, one)
        alpha = invert_cdf(np.array([level(fknee, s) for s in slopes]), slopes, two)
    return fknee, alpha


@dataclass(frozen=True)
class NoiseStep:
    """What one step of the noise of a scan gives."""

    noise: np.ndarray
    sigma0: float
    fknee: float
    alpha: float
    status: str


def noise_step(x: np.ndarray, mask: np.ndarray, fsamp: float, sigma0: float | None, fknee: float, alpha: float, draws: tuple[np.ndarray, np.ndarray, np.ndarray], mode: str = "full", most: int = 100, **options) -> NoiseStep:
    """Noise of a scan with gaps: its white level (from the binned spectrum where none is given), the
    correlated draw, the checked variance and the parameters.

    *mode*: ``full``; ``offset`` draws the mean alone; ``no_offset`` draws without the mean.  With
    *most* of 0 the stationary draw is taken.  A draw that is not finite, or varies over a hundred
    times as much as the samples, is replaced by zeros and the parameters stay.
    """
    good = mask.astype(bool)
    if not good.any():
        return NoiseStep(np.zeros(len(x)), float("inf"), fknee, alpha, "empty")
    level = sigma_of_psd(np.where(good, x, x[good].mean()), fsamp, fsamp / 20) if sigma0 is None else sigma0
    if not 0 < level < float("inf"):
        raise ValueError("a scan's noise level is zero or infinite")
    mean = x[good].mean()
    if mode == "offset":
        return NoiseStep(np.full(len(x), mean + draws[0][0] * level / np.sqrt(good.sum())), level, fknee, alpha, "offset")
    f = np.fft.rfftfreq(2 * len(x), 1 / fsamp)
    c = oof(f, level, fknee, alpha, white=False)
    inverse = np.where(c > 0, 1 / np.where(c > 0, c, 1.0), 0.0)
    y = x - mean if mode == "no_offset" else x
    filled = np.where(good, y, y[good].mean())
    if most:
        draw = constrained_noise(filled, mask, level, inverse, *draws[:2], most=most)
        noise, status = draw.noise, "converged" if draw.converged else "not_converged"
    else:
        noise, status = stationary_noise(filled, level, inverse, *draws[:2]), "stationary"
    if mode == "no_offset":
        noise = noise - noise.mean()
    if not np.isfinite(noise).all() or np.var(noise) > 100 * max(np.var(x[good]), level**2):
        return NoiseStep(np.zeros(len(x)), level, fknee, alpha, "high_variance")
    fknee, alpha = fitted_parameters(filled - filled.mean(), fsamp, level, fknee, alpha, draws[2], **options)
    return NoiseStep(noise, level, fknee, alpha, status)
