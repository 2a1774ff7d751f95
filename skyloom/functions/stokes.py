"""Detector response, sky projection and the orbital dipole, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.geometry import pix2vec

#: Speed of light (m/s), Planck's constant over Boltzmann's (s K) and CMB temperatures, by use.
C_LIGHT = 299792458.0
H_OVER_K = 6.62607015e-34 / 1.380649e-23
T_CMB_DIPOLE_UK = 2.725e6
T_CMB_SIMULATION = 2.72548
T_CMB_SED = 2.7255


def response(psi: Column, r_i: Column | float = 1.0, r_qu: Column | float = 1.0) -> tuple[Column, Column, Column]:
    """Response of a sample to I, Q and U."""
    i = r_i if isinstance(r_i, Column) else F.lit(r_i)
    return i, F.cos(psi * 2.0) * r_qu, F.sin(psi * 2.0) * r_qu


def project(psi: Column, i: Column | None, q: Column | None = None, u: Column | None = None) -> Column:
    """Signal of a sample from the Stokes values of its pixel; a missing parameter counts as none."""
    zero = F.lit(0.0)
    out = zero if i is None else F.coalesce(i, zero)
    for value, trig in ((q, F.cos), (u, F.sin)):
        if value is not None:
            out = out + F.coalesce(value, zero) * trig(psi * 2.0)
    return out


def planck_ratio(nu_ghz: Column, temperature: float = T_CMB_SED) -> Column:
    """x^2 e^x / (e^x - 1)^2: thermodynamic to brightness temperature."""
    x = nu_ghz * (1e9 * H_OVER_K / temperature)
    return x * x * F.exp(x) / F.pow(F.expm1(x), 2)


def orbital_dipole(nside: int, pix: Column, v: tuple[Column, Column, Column], nu_ghz: Column) -> Column:
    """First-order dipole in brightness temperature; *v* in m/s."""
    x, y, z = pix2vec(nside, pix)
    return (x * v[0] + y * v[1] + z * v[2]) * (T_CMB_DIPOLE_UK / C_LIGHT) * planck_ratio(nu_ghz)


def relativistic_dipole(nside: int, pix: Column, v: tuple[Column, Column, Column], temperature: float = T_CMB_SIMULATION) -> Column:
    """T (1 / (gamma (1 - beta n)) - 1)."""
    x, y, z = pix2vec(nside, pix)
    beta = [c / C_LIGHT for c in v]
    gamma = F.lit(1.0) / F.sqrt(F.lit(1.0) - (beta[0] * beta[0] + beta[1] * beta[1] + beta[2] * beta[2]))
    return (F.lit(1.0) / (gamma * (F.lit(1.0) - (x * beta[0] + y * beta[1] + z * beta[2]))) - 1.0) * temperature
