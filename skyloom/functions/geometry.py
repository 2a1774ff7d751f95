"""Pixelisation of the sphere (RING order) and pointing, as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quarter_turns(phi: Column) -> Column:
    """Longitude in quarter turns, in [0, 4)."""
    return F.pmod(phi * (2.0 / pi), F.lit(4.0))


def ang2pix(nside: int, theta: Column, phi: Column) -> Column:
    """Pixel that holds the direction; near the poles the sine of theta replaces 1 - |z|."""
    n = float(nside)
    z, tt = F.cos(theta), quarter_turns(phi)
    za = F.abs(z)
    base, slope = (tt + 0.5) * n, z * (0.75 * n)
    jp, jm = F.floor(base - slope), F.floor(base + slope)
    ring = F.lit(nside + 1) + jp - jm
    shift = F.lit(1) - F.pmod(ring, F.lit(2))
    along = F.pmod(F.floor((jp + jm - nside + shift + 1) / 2), F.lit(4 * nside))
    belt = F.lit(2 * nside * (nside - 1)) + (ring - 1) * (4 * nside) + along
    tp = tt - F.floor(tt)
    reach = F.when(za < 0.99, F.sqrt((F.lit(1.0) - za) * 3.0)).otherwise(F.sin(theta) / F.sqrt((za + 1.0) / 3.0)) * n
    cp, cm = F.floor(tp * reach), F.floor((F.lit(1.0) - tp) * reach)
    cap_ring = cp + cm + 1
    cap_along = F.pmod(F.floor(tt * cap_ring), cap_ring * 4)
    north = cap_ring * 2 * (cap_ring - 1) + cap_along
    south = F.lit(12 * nside * nside) - cap_ring * 2 * (cap_ring + 1) + cap_along
    return F.when(za <= 2.0 / 3.0, belt).when(z > 0, north).otherwise(south).cast("long")


def with_pixel(df: DataFrame, nside: int, theta: Column, phi: Column, out: str = "pix") -> DataFrame:
    """*df* with the pixel that holds the direction: ``ang2pix`` in steps, so that what several
    branches share is computed once a row."""
    n, own = float(nside), df.columns
    turn = phi * (2.0 / pi)
    step = df.withColumn("_t", theta).withColumn("_z", F.cos("_t")).withColumn("_q", turn * 0.25).withColumn("_tt", (F.col("_q") - F.floor("_q")) * 4.0)
    z, tt, za = F.col("_z"), F.col("_tt"), F.abs("_z")
    reach = F.when(za < 0.99, F.sqrt((F.lit(1.0) - za) * 3.0)).otherwise(F.sin("_t") / F.sqrt((za + 1.0) / 3.0)) * n
    step = step.withColumn("_base", (tt + 0.5) * n).withColumn("_slope", z * (0.75 * n)).withColumn("_reach", reach).withColumn("_tp", tt - F.floor(tt))
    step = step.withColumn("_jp", F.floor(F.col("_base") - F.col("_slope"))).withColumn("_jm", F.floor(F.col("_base") + F.col("_slope")))
    step = step.withColumn("_cap", F.floor(F.col("_tp") * F.col("_reach")) + F.floor((F.lit(1.0) - F.col("_tp")) * F.col("_reach")) + 1)
    jp, jm, cap = F.col("_jp"), F.col("_jm"), F.col("_cap")
    ring = jp - jm + (nside + 1)
    along = F.pmod(F.shiftright(jp + jm - nside + 2 - ring.bitwiseAND(F.lit(1)), 1), F.lit(4 * nside))
    step = step.withColumn("_round", F.floor(tt * cap) % (cap * 4)).withColumn("_belt", (ring - 1) * (4 * nside) + along + 2 * nside * (nside - 1))
    found = F.when(za <= 2.0 / 3.0, F.col("_belt")).when(z > 0, cap * 2 * (cap - 1) + F.col("_round")).otherwise(F.lit(12 * nside * nside) - cap * 2 * (cap + 1) + F.col("_round"))
    return step.select(*own, found.cast("long").alias(out))


def _ring_of(nside: int, pix: Column) -> tuple[Column, Column, Column, Column]:
    """Zone test columns: in the north cap, in the belt; and cap rings counted from each pole."""
    npix, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    north = F.floor((F.sqrt(pix.cast("double") * 2.0 + 1.0) + 1.0) / 2.0)
    south = F.floor((F.sqrt((F.lit(npix) - pix).cast("double") * 2.0 - 1.0) + 1.0) / 2.0)
    return pix < cap, pix < npix - cap, north, south


def pix2z(nside: int, pix: Column) -> Column:
    """cos(theta) of a pixel's centre."""
    in_north, in_belt, north, south = _ring_of(nside, pix)
    belt_ring = F.floor((pix - 2 * nside * (nside - 1)) / (4 * nside)) + nside
    third = 1.0 / (3.0 * nside * nside)
    return (
        F.when(in_north, F.lit(1.0) - north * north * third)
        .when(in_belt, (F.lit(2 * nside) - belt_ring).cast("double") * (2.0 / (3.0 * nside)))
        .otherwise(south * south * third - 1.0)
    )


def pix2phi(nside: int, pix: Column) -> Column:
    """Longitude of a pixel's centre."""
    npix, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    in_north, in_belt, north, south = _ring_of(nside, pix)
    belt_ring = F.floor((pix - cap) / (4 * nside)) + nside
    belt_at = F.pmod(pix - cap, F.lit(4 * nside))
    half = F.when(F.pmod(belt_ring + nside, F.lit(2)) == 0, 0.5).otherwise(0.0)
    first_south = F.lit(npix) - south * 2 * (south + 1)
    return (
        F.when(in_north, ((pix - north * 2 * (north - 1)).cast("double") + 0.5) * (pi / 2) / north)
        .when(in_belt, (belt_at.cast("double") + half) * (pi / 2 / nside))
        .otherwise(((pix - first_south).cast("double") + 0.5) * (pi / 2) / south)
    )


def pix2vec(nside: int, pix: Column) -> tuple[Column, Column, Column]:
    z, phi = pix2z(nside, pix), pix2phi(nside, pix)
    s = F.sqrt((F.lit(1.0) - z) * (z + 1.0))
    return s * F.cos(phi), s * F.sin(phi), z


def regrade(nside_in: int, nside_out: int, pix: Column) -> Column:
    """Pixel of another resolution that holds a pixel's centre; the parent when degrading."""
    return ang2pix(nside_out, F.acos(pix2z(nside_in, pix)), pix2phi(nside_in, pix))


def with_coarser(df: DataFrame, nside_in: int, nside_out: int) -> DataFrame:
    """*df* with ``pix`` replaced by the pixel of another resolution that holds its centre."""
    if nside_in == nside_out:
        return df
    columns = df.columns
    centres = df.withColumn("_theta", F.acos(pix2z(nside_in, F.col("pix")))).withColumn("_phi", pix2phi(nside_in, F.col("pix")))
    return with_pixel(centres, nside_out, F.col("_theta"), F.col("_phi"), "_pix").select(*(F.col("_pix").alias("pix") if c == "pix" else c for c in columns))


def psi_of_bin(code: Column, npsi: int) -> Column:
    return code.cast("double") * (2.0 * pi / npsi)


def bin_of_psi(psi: Column, npsi: int) -> Column:
    """Nearest bin, halves to even."""
    return F.bround(psi * (npsi / (2.0 * pi)), 0).cast("long")


def bearing(theta: Column, phi: Column, theta2: Column, phi2: Column) -> Column:
    """Great-circle bearing from one direction to the next, from colatitudes and longitudes."""
    d = phi2 - phi
    return F.atan2(F.sin(d) * F.sin(theta2), F.sin(theta) * F.cos(theta2) - F.cos(theta) * F.sin(theta2) * F.cos(d))


def separation(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    """Angle between two directions (haversine)."""
    a = F.pow(F.sin((lat2 - lat) / 2.0), 2) + F.cos(lat) * F.cos(lat2) * F.pow(F.sin((lon2 - lon) / 2.0), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * 2.0


def quaternion_product(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Hamilton product of (w, x, y, z) quaternions."""
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def rotation_z(angle: Column) -> tuple[Column, ...]:
    return F.cos(angle / 2.0), F.lit(0.0), F.lit(0.0), F.sin(angle / 2.0)


def rotation_y(angle: Column) -> tuple[Column, ...]:
    return F.cos(angle / 2.0), F.lit(0.0), F.sin(angle / 2.0), F.lit(0.0)


def quaternion_angles(q: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """(theta, phi, psi) of a quaternion read as Rz(phi) Ry(theta) Rz(psi)."""
    w, x, y, z = q
    theta = F.atan2(F.sqrt(x * x + y * y), F.sqrt(w * w + z * z)) * 2.0
    total, less = F.atan2(z, w), F.atan2(-x, y)
    return theta, total + less, total - less


def celestial(az: Column, el: Column, latitude: float, sidereal: Column) -> tuple[Column, Column]:
    """(declination, right ascension) of a horizontal direction seen from a latitude at a local sidereal time.

    Azimuth counts from north through east.  Refraction, precession and nutation are left out.
    """
    lat = F.lit(latitude)
    dec = F.asin(F.sin(lat) * F.sin(el) + F.cos(lat) * F.cos(el) * F.cos(az))
    hour = F.atan2(-(F.cos(el) * F.sin(az)), F.sin(el) * F.cos(lat) - F.cos(el) * F.sin(lat) * F.cos(az))
    return dec, sidereal - hour


def sidereal_time(seconds: Column, longitude: float) -> Column:
    """Local angle of the Earth's rotation at Unix seconds (UT1 taken as UTC)."""
    days = (seconds - 946728000.0) / 86400.0  # since 2000 January 1, noon
    return (F.lit(0.7790572732640) + days * 1.00273781191135448) * (2.0 * pi) + longitude
