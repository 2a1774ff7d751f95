"""Point sources: discs of pixels by angular distance, maps and their adjoint."""

from __future__ import annotations

from math import asin, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geometry as geo
from skyloom.functions.spectra import beam_profile
from skyloom.operators.mapmaking import small


def beams(sources: DataFrame, nside: int, fwhm: float, radius: float) -> DataFrame:
    """Rows (source columns, pix, sep, beam) of the pixels within *radius* of each source.

    Sources and pixels meet by rings of latitude: a source is sent to the bands its disc
    touches, so a pair is only tested where it may be close.
    """
    spark = sources.sparkSession
    width = max(radius, 1e-3)
    n = int(pi / width) + 1
    band = lambda lat: F.floor((lat + pi / 2) / width)
    z = geo.pix2z(nside, F.col("id"))
    pixels = spark.range(12 * nside * nside).select(F.col("id").alias("pix"), F.asin(z).alias("_lat"), geo.pix2phi(nside, F.col("id")).alias("_lon"))
    pixels = pixels.withColumn("_band", band(F.col("_lat")))
    reach = F.sequence(F.greatest(F.lit(0).cast("long"), band(F.col("lat") - radius)), F.least(F.lit(n).cast("long"), band(F.col("lat") + radius)))
    sent = sources.withColumn("_band", F.explode(reach))
    sep = geo.separation(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    out = sent.join(small(pixels, 12 * nside * nside), "_band").withColumn("sep", sep).where(F.col("sep") <= radius)
    return out.withColumn("beam", beam_profile(F.col("sep"), fwhm)).drop("_band", "_lat", "_lon")


def source_map(discs: DataFrame, amplitude: Column) -> DataFrame:
    return discs.groupBy("pix").agg(F.count(F.lit(1)).alias("n"), F.sum(amplitude * F.col("beam")).alias("value"))


def source_values(discs: DataFrame, maps: DataFrame) -> DataFrame:
    """Adjoint: the map under each source's beam."""
    return discs.join(maps, "pix").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("beam") * F.col("value")).alias("value"))


def disc_area(radius: float) -> float:
    """Solid angle of a disc."""
    return 4 * pi * asin(min(1.0, radius / 2)) ** 2
