"""The two half-steps of a Gibbs iteration on samples, and a chain that is written as it grows.

A half-step is a function from tables to tables: the first takes samples, a sky and gains to new
gains and band maps, the second band maps to component maps and so to the next sky.  What a step
gives is written by the sinks and read back, so an iteration's lineage ends with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import calibration as cal
from skyloom.operators import dense
from skyloom.operators import mapmaking as mm
from skyloom.sources import sinks

SCAN = ["band", "det_id", "scan_id"]


def first_gains(samples: DataFrame) -> DataFrame:
    """band, det_id, scan_id and gains of 1, 0 and 0."""
    return samples.select(*SCAN).distinct().select(*SCAN, F.lit(1.0).alias("g_abs"), F.lit(0.0).alias("g_rel"), F.lit(0.0).alias("g_temp"))


def resumed(fresh: DataFrame, chain: DataFrame | None) -> DataFrame:
    """Gains of a chain's iteration for the scans it has; the fresh ones for all others."""
    if chain is None:
        return fresh
    old = chain.select(*SCAN, *(F.col(g).alias(f"_{g}") for g in ("g_abs", "g_rel", "g_temp")))
    return fresh.join(old, SCAN, "left").select(*SCAN, *(F.coalesce(f"_{g}", g).alias(g) for g in ("g_abs", "g_rel", "g_temp")))


def calibrate(samples: DataFrame, sky: DataFrame, gains: DataFrame, npix: int, eta: Column | None = None) -> DataFrame:
    """New gains: absolute a band, relative a detector (changes sum to zero), temporal a scan, each
    given the others as last drawn.  *eta* is a supplied unit draw a row; without it the fits are means.

    Samples meet the sky once; all three fits are algebra on the sums s w d and s w s of each scan.
    """
    draw = F.lit(0.0) if eta is None else eta
    weight = F.lit(1.0) / (F.col("sigma0") * F.col("sigma0"))
    sums = cal.fit_sums(mm.with_sky(samples, sky, npix), SCAN, F.col("signal"), F.col("tod"), weight).join(gains, SCAN)
    # of a fit of x + y to the data, that of x has the right side r - y d
    by_band = sums.groupBy("band").agg(F.sum(F.col("r") - (F.col("g_rel") + F.col("g_temp")) * F.col("d")).alias("r"), F.sum("d").alias("d"), F.first("g_abs").alias("old"))
    absolute = cal.absolute_gain(by_band.withColumn("eta", draw), ["band"], F.lit(1.0), F.col("eta")).select("band", F.col("gain").alias("g_abs"))
    sums = sums.drop("g_abs").join(absolute, "band")
    by_det = sums.groupBy("band", "det_id").agg(F.sum(F.col("r") - (F.col("g_abs") + F.col("g_temp")) * F.col("d")).alias("r"), F.sum("d").alias("d"))
    relative = cal.relative_gain(by_det, ["band"], "det_id", F.lit(0.0), draw).select("band", "det_id", F.col("gain").alias("g_rel"))
    sums = sums.drop("g_rel").join(relative, ["band", "det_id"])
    d = F.when(F.col("d") > 0, F.col("d"))
    temporal = F.coalesce(F.col("r") / d - F.col("g_abs") - F.col("g_rel") + draw / F.sqrt(d), F.lit(0.0))
    return sums.select(*SCAN, "g_abs", "g_rel", temporal.alias("g_temp"))


def band_maps(samples: DataFrame, gains: DataFrame) -> DataFrame:
    """Binned maps of the calibrated samples, weighted by (gain / sigma0)^2."""
    g = F.col("g_abs") + F.col("g_rel") + F.col("g_temp")
    # a gain of 0 says nothing of the sky
    s = samples.join(gains, SCAN).where(g != 0)
    weight = (g / F.col("sigma0")) * (g / F.col("sigma0"))
    return mm.solve_maps(mm.normal_equations(s, ["band", "pix"], weight, F.col("tod") / g), ["band", "pix"])


def separate(maps: DataFrame, mixing: DataFrame, count: int) -> DataFrame:
    """pix, c0, c1, ... of the bands' intensity; *mixing* is (band, m0, m1, ...)."""
    x = maps.where("rms_i < double('infinity')").join(mm.small(mixing, 1 << 16), "band")
    columns = [F.col(f"m{k}") for k in range(count)]
    sums = mm.mixing_sums(x.select("pix", "s_i", "rms_i", *(F.col(f"m{k}").alias(f"x{k}") for k in range(count))), "pix", [F.col(f"x{k}") for k in range(len(columns))], F.col("s_i"), F.lit(1.0) / (F.col("rms_i") * F.col("rms_i")))
    return dense.solve_rows(sums, "pix", count)


def next_sky(components: DataFrame, mixing: DataFrame, count: int) -> DataFrame:
    """band, pix, s_i of the components."""
    value = sum((F.col(f"c{k}") * F.col(f"m{k}") for k in range(count)), F.lit(0.0))
    return components.crossJoin(F.broadcast(mixing)).select("band", "pix", value.alias("s_i"))  # a row a band


@dataclass(frozen=True)
class Chain:
    """Where a chain is written, and of which number it is."""

    spark: SparkSession
    path: str
    number: int = 1

    def keep(self, what: str, df: DataFrame, iteration: int, keys: tuple[str, ...] = ("band",)) -> DataFrame:
        """Write what a step gave and read it back."""
        sinks.write_chain(df, f"{self.path}/{what}", self.number, iteration, keys)
        return self.last(what, iteration)

    def last(self, what: str, iteration: int | None = None) -> DataFrame:
        return sinks.read_chain(self.spark, f"{self.path}/{what}", self.number, iteration).drop("chain", "iter")


def run(chain: Chain, samples: DataFrame, sky: DataFrame, mixing: DataFrame, count: int, npix: int, iterations: int, gains: DataFrame | None = None) -> DataFrame:
    """A chain of both half-steps from a first sky (pix, s_i, s_q, s_u); the last iteration's maps.

    Each step reads only what is written, so a run that stops goes on from its last iteration.
    """
    gains = first_gains(samples) if gains is None else gains
    maps = None
    for k in range(1, iterations + 1):
        gains = chain.keep("gains", calibrate(samples, sky, gains, npix), k)
        maps = chain.keep("maps", band_maps(samples, gains), k)
        components = chain.keep("components", separate(maps, mixing, count), k, ())
        total = next_sky(components, mixing, count).groupBy("pix").agg(F.avg("s_i").alias("s_i"))
        polarised = maps.groupBy("pix").agg(F.avg("s_q").alias("s_q"), F.avg("s_u").alias("s_u"))
        sky = total.join(polarised, "pix")
    return maps
