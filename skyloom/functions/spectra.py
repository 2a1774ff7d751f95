"""Spectral energy distributions, unit factors, beams, priors and noise spectra, as Column expressions."""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.stokes import H_OVER_K, planck_ratio

_H, _K, _C = 6.62607015e-34, 1.380649e-23, 299792458.0


def cmb(nu: Column) -> Column:
    """Thermodynamic to brightness temperature at *nu* GHz."""
    return planck_ratio(nu)


def thermal_dust(nu: Column, nu_ref: float, beta: float, temperature: float) -> Column:
    """Modified blackbody in brightness temperature, one at the reference frequency."""
    per = 1e9 * H_OVER_K / temperature
    return F.pow(nu / nu_ref, F.lit(beta + 1.0)) * F.expm1(F.lit(per * nu_ref)) / F.expm1(nu * per)


def synchrotron(nu: Column, nu_ref: float, beta: float) -> Column:
    return F.pow(nu / nu_ref, F.lit(beta))


def gaunt(nu: Column, temperature: float) -> Column:
    """Free-free Gaunt factor; *nu* in GHz."""
    return F.log(F.exp(F.lit(5.960) - F.log(nu * (temperature / 1e4) ** -1.5) * (sqrt(3.0) / pi)) + F.exp(F.lit(1.0)))


def free_free(nu: Column, nu_ref: float, temperature: float) -> Column:
    return F.pow(F.lit(nu_ref) / nu, F.lit(2.0)) * gaunt(nu, temperature) / gaunt(F.lit(nu_ref), temperature)


def radio_source(nu: Column, nu_ref: float, alpha: Column) -> Column:
    return F.pow(nu / nu_ref, alpha - 2.0)


def blackbody(nu_ghz: Column, temperature: float) -> Column:
    """Planck's law in W / (m^2 Hz sr)."""
    return F.pow(nu_ghz * 1e9, F.lit(3.0)) * (2.0 * _H / _C**2) / F.expm1(nu_ghz * (1e9 * _H / (_K * temperature)))


def unit_factor(nu_ghz: Column, unit: Column) -> Column:
    """Factor from uK of brightness temperature to *unit*; an unknown unit gives null."""
    to_cmb = F.lit(1.0) / planck_ratio(nu_ghz)
    mjy = F.pow(nu_ghz * 1e9, F.lit(2.0)) * (2.0 * _K / _C**2 * 1e20 * 1e-6)
    return (
        F.when(unit == "uK_RJ", 1.0)
        .when(unit == "mK_RJ", 1e-3)
        .when(unit == "K_RJ", 1e-6)
        .when(unit == "uK_CMB", to_cmb)
        .when(unit == "mK_CMB", to_cmb * 1e-3)
        .when(unit == "K_CMB", to_cmb * 1e-6)
        .when(unit == "MJy/sr", mjy)
    )


def beam_sigma(fwhm_arcmin: float) -> float:
    return fwhm_arcmin * pi / 180.0 / 60.0 / sqrt(8.0 * log(2.0))


def beam_window(ell: Column, fwhm_arcmin: float) -> Column:
    """Gaussian beam in multipole space."""
    return F.exp(ell * (ell + 1.0) * (-0.5 * beam_sigma(fwhm_arcmin) ** 2))


def beam_profile(x: Column, fwhm: float) -> Column:
    """Gaussian beam in map space, one at the centre."""
    return F.exp(x * x * (-4.0 * log(2.0) / fwhm**2))


def beam_radius(fwhm: float, fraction: float) -> float:
    """Radius at which the beam has fallen to *fraction*."""
    return fwhm / sqrt(8.0 * log(2.0)) * sqrt(-2.0 * log(fraction))


def prior_spectrum(ell: Column, amplitude: float, pivot: float, beta: float, fwhm_arcmin: float) -> Column:
    """C_l of a power law with a smooth cut; l = 0 has the value of D at l = 1."""
    at = F.greatest(ell, F.lit(1)).cast("double")
    cut = F.greatest(F.exp(at * (at + 1.0) * -(beam_sigma(fwhm_arcmin) ** 2)), F.lit(1e-10))
    d = F.pow(at / pivot, F.lit(beta)) * amplitude * cut
    return F.when(ell == 0, d).otherwise(d * (2.0 * pi) / (at * (at + 1.0)))


def noise_full(f: Column, sigma0: Column, fknee: Column, alpha: Column) -> Column:
    """sigma0^2 (1 + (f / fknee)^alpha); sigma0^2 at f = 0."""
    return F.when(f <= 0, sigma0 * sigma0).otherwise(sigma0 * sigma0 * (F.pow(F.when(f > 0, f).otherwise(1.0) / fknee, alpha) + 1.0))


def noise_corr(f: Column, sigma0: Column, fknee: Column, alpha: Column) -> Column:
    """The correlated part; 0 at f = 0."""
    return F.when(f <= 0, 0.0).otherwise(sigma0 * sigma0 * F.pow(F.when(f > 0, f).otherwise(1.0) / fknee, alpha))


def inverse_or_zero(x: Column) -> Column:
    return F.when(x > 0, F.lit(1.0) / F.when(x > 0, x).otherwise(1.0)).otherwise(0.0)


def log_prior(x: Column, kind: str, mean: float, rms: float, low: float, high: float) -> Column:
    """Bounded gaussian or lognormal prior; -1e30 outside; flat for a width of 0 or less."""
    if rms <= 0:
        inside = F.lit(0.0)
    elif kind == "lognormal":
        inside = F.pow((F.log(F.when(x > 0, x).otherwise(1.0)) - log(mean)) / rms, 2) * -0.5
    else:
        inside = F.pow((x - mean) / rms, 2) * -0.5
    return F.when((x < low) | (x > high), -1e30).otherwise(inside)


def single_pole(f: Column, tau: float) -> tuple[Column, Column]:
    """(re, im) of 1 / (1 + 2 pi i f tau)."""
    w = f * (2.0 * pi * tau)
    d = w * w + 1.0
    return F.lit(1.0) / d, -w / d


def multi_pole(f: Column, amplitudes: list[float], taus: list[float]) -> tuple[Column, Column]:
    """(re, im) of the normalised sum of poles."""
    total = sum(amplitudes)
    re, im = F.lit(0.0), F.lit(0.0)
    for a, tau in zip(amplitudes, taus, strict=True):
        r, i = single_pole(f, tau)
        re, im = re + r * (a / total), im + i * (a / total)
    return re, im
