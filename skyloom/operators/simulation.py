"""Table-generating simulation: scan strategies and detector cross-talk."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import fourier
from skyloom.operators.mapmaking import small


def raster(spark: SparkSession, offset: int, n: int, per_row: int, rows: int) -> DataFrame:
    """Raster scan: row, share of the row done and angle pi times that."""
    i = F.col("id")
    x = spark.range(offset, offset + n).select(i.alias("sample"), (F.floor(i / per_row) % rows).alias("row"), (i % per_row / float(per_row)).alias("frac"))
    return x.withColumn("psi", F.col("frac") * pi)


def spin(spark: SparkSession, n: int, year: float, period: float, opening: float) -> DataFrame:
    """Direction of a beam at an angle to a spin axis that stays anti-Sun over a year."""
    al, be = F.col("id") * (2 * pi / year), F.col("id") * (2 * pi / period)
    c, s = cos(opening), sin(opening)
    return spark.range(n).select(
        F.col("id").alias("sample"),
        (F.cos(al) * c - F.sin(be) * F.sin(al) * s).alias("x"),
        (F.sin(al) * c + F.sin(be) * F.cos(al) * s).alias("y"),
        (F.cos(be) * s).alias("z"),
    )


def cross_talk_matrix(spark: SparkSession, ndet: int, leak: float) -> DataFrame:
    """I + leak (1 - I) in rows (det_id, from_det, x)."""
    a = spark.range(ndet).toDF("det_id")
    return a.crossJoin(a.toDF("from_det")).withColumn("x", F.when(F.col("det_id") == F.col("from_det"), 1.0).otherwise(leak))


def cross_talk(samples: DataFrame, matrix: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each detector's samples as the mix of all detectors' at the same place."""
    source = samples.withColumnRenamed("det_id", "from_det")
    return source.join(small(matrix, 1 << 16), "from_det").groupBy("det_id", *keys).agg(F.sum(F.col("x") * F.col(value)).alias("mixed"))


def noise(n: int, fsamp: float, sigma0: float, fknee: float, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """White noise shaped to a 1/f spectrum; the zero mode has half the first frequency's level. A knee of 0 is white."""
    x = rng.standard_normal(n) * sigma0
    if fknee <= 0 or n < 2:
        return x
    f = np.fft.rfftfreq(n, 1 / fsamp)
    f[0] = f[1] / 2
    return np.fft.irfft(np.fft.rfft(x) * np.sqrt(1 + (f / fknee) ** alpha), n)


def simulate(samples: DataFrame, keys: list[str], signal: str, seed: int, fsamp: float, sigma0: float, fknee: float = 0.0, alpha: float = -1.0, gain: float = 1.0, tau: float = 0.0, response: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Replace each detector-scan's samples by T(gain * signal) + noise; T is a time constant or any *response* of frequency.

    The draw is keyed by the seed and the scan's keys, so a lost task repeats the same samples
    whatever the partitions.
    """
    import zlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *(zlib.crc32(str(pdf[k].iloc[0]).encode()) for k in keys)])
        x = gain * pdf[signal].to_numpy(float)
        if tau or response:
            x = fourier.transfer(x, fsamp, response or (lambda f: 1 / (1 + 2j * pi * f * tau)))
        return pdf[[*keys, "i"]].assign(tod=x + noise(len(x), fsamp, sigma0, fknee, alpha, rng))

    types = dict(samples.dtypes)
    return fourier.over_scans(samples, keys, run, ", ".join([*(f"{k} {types[k]}" for k in keys), "i long", "tod double"]))


def stored_pointing(pointing: DataFrame, offset: int, n: int, det_offset: int = 0) -> DataFrame:
    """The samples [offset, offset + n) of a stored pointing, counted from 0, for a detector further on."""
    at = F.col("sample") - (offset + det_offset)
    return pointing.where((at >= 0) & (at < n)).withColumn("sample", at)


def alms_of_spectrum(cl: DataFrame, draws: DataFrame, least: int = 0) -> DataFrame:
    """l, m, re, im: unit draws (l, m, re, im) times the root of a spectrum (l, cl); none below *least*.

    Complex draws have a mean square of 1, real ones (m = 0) too.
    """
    both = draws.join(small(cl, 1 << 16), "l").where(F.col("l") >= least)
    return both.select("l", "m", *((F.col(c) * F.sqrt("cl")).alias(c) for c in ("re", "im")))
