"""Gain calibration and data selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decompose_gains(df: DataFrame, det: str, gain: str) -> DataFrame:
    """Absolute (mean of all), relative (mean of a detector less that) and temporal (the rest) gain."""
    total = df.agg(F.avg(gain).alias("g_abs"))
    by_det = df.groupBy(det).agg(F.avg(gain).alias("_mean"))
    out = df.join(by_det, det).crossJoin(F.broadcast(total))  # one row
    return out.withColumns({"g_rel": F.col("_mean") - F.col("g_abs"), "g_temp": F.col(gain) - F.col("_mean")}).drop("_mean")


def fit_sums(df: DataFrame, keys: list[str], signal: Column, data: Column, weight: Column) -> DataFrame:
    """r = sum s N^-1 d and d = sum s N^-1 s."""
    return df.groupBy(*keys).agg(F.sum(signal * weight * data).alias("r"), F.sum(signal * weight * signal).alias("d"))


def absolute_gain(sums: DataFrame, keys: list[str], previous: Column, eta: Column) -> DataFrame:
    """r / d + eta / sqrt d; a weight that is not positive leaves the previous gain."""
    d = F.when(F.col("d") > 0, F.col("d"))
    return sums.select(*keys, F.coalesce(F.col("r") / d + eta / F.sqrt(d), previous).alias("gain"))


def relative_gain(sums: DataFrame, keys: list[str], det: str, previous: Column, eta: Column) -> DataFrame:
    """Gains of the detectors of a group under sum = 0 of the changes, in closed form.

    Each detector's unconstrained solution moves by the share of the multiplier that its weight
    leaves; detectors without weight keep their previous gain.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = F.when(F.col("d") > 0, F.col("d"))
    top = F.col("r") + F.sqrt(d) * eta
    half = F.sum(top / d).over(group) / F.sum(F.lit(1.0) / d).over(group)
    return sums.select(*keys, det, F.coalesce((top - half) / d, previous).alias("gain"))


def accepted(stats: DataFrame, scan: list[str], least_good: float, most_z: float) -> DataFrame:
    """Keys of the detector-scans that neither cut rejects: too few good samples, or a chi-square too far off or none."""
    return stats.where((F.col("good_fraction") >= least_good) & ~F.isnan("chisq_z") & (F.abs("chisq_z") <= most_z)).select(*scan)


def selection_window(parameters: dict, iteration: int, noise_drawn: bool) -> tuple[bool, float, float]:
    """Whether the cuts are active in an iteration, largest |z| and least good fraction.

    They are where they are enabled, the iteration lies in their window (both ends included) and
    the correlated noise, where they wait for it, has been drawn.
    """
    first, last = parameters.get("first", 1), parameters.get("last", float("inf"))
    active = parameters.get("enabled", False) and first <= iteration <= last and (noise_drawn or not parameters.get("needs_noise", True))
    return active, parameters.get("most_z", 1e4), parameters.get("least_good", 0.1)


def selection_counts(stats: DataFrame, keys: list[str], least_good: float, most_z: float) -> DataFrame:
    """Detector-scans present, accepted and rejected by each cut, with percentiles of |z|."""
    low = F.col("good_fraction") < least_good
    bad = ~low & (F.isnan("chisq_z") | (F.abs("chisq_z") > most_z))
    z = F.when(~F.isnan("chisq_z"), F.abs("chisq_z"))
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("present"),
        F.count_if(~low & ~bad).alias("accepted"),
        F.count_if(low).alias("low_fraction"),
        F.count_if(bad).alias("bad_chisq"),
        F.percentile(z, F.lit(0.05)).alias("p5"),
        F.percentile(z, F.lit(0.5)).alias("p50"),
        F.percentile(z, F.lit(0.95)).alias("p95"),
        F.max(z).alias("worst"),
    )


def median_mad(df: DataFrame, keys: list[str], value: str, least: int = 10) -> DataFrame:
    """Median and 1.4826 MAD of a group; infinite spread for few values or none."""
    over = Window.partitionBy(*keys)
    out = df.withColumn("_m", F.median(value).over(over)).groupBy(*keys).agg(
        F.first("_m").alias("median"), (F.median(F.abs(F.col(value) - F.col("_m"))) * 1.4826).alias("_s"), F.count(value).alias("n")
    )
    return out.select(*keys, "n", "median", F.when((F.col("n") >= least) & (F.col("_s") > 0), F.col("_s")).otherwise(float("inf")).alias("spread"))
