"""Map-making with operators on whole scans: P^T T^T N^-1 T P m = P^T T^T N^-1 d.

P projects a map to samples, T is a transfer function and N^-1 an inverse noise covariance, both on
whole detector-scans.  One application is a join with the map, a grouped function over scans
and an aggregation by pixel; a solution applies it once an iteration, a Spark job each, and reads
the samples from their table every time.  The map's vectors are tables of one row a pixel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import linalg, stokes
from skyloom.operators import fourier
from skyloom.operators.mapmaking import PACKED, normal_sums, small

STOKES = ("s_i", "s_q", "s_u")


@dataclass(frozen=True)
class ScanModel:
    """What happens to a scan: a transfer function of frequency (None: none) and the inverse noise
    covariance as a function of (samples, sigma0)."""

    fsamp: float
    inverse_noise: Callable[[np.ndarray, float], np.ndarray]
    response: Callable[[np.ndarray], np.ndarray] | None = None

    def transfer(self, x: np.ndarray) -> np.ndarray:
        return x if self.response is None else fourier.transfer(x, self.fsamp, self.response)

    def transfer_adjoint(self, x: np.ndarray) -> np.ndarray:
        return x if self.response is None else fourier.transfer(x, self.fsamp, self.response, adjoint=True)

    def data_side(self, d: np.ndarray, sigma0: float) -> np.ndarray:
        """T^T N^-1 d; a scan that is empty or not finite is an error, since one bad sample reaches all pixels."""
        if not len(d) or not np.isfinite(d).all():
            raise ValueError("a scan is empty or has samples that are not finite")
        return self.transfer_adjoint(self.inverse_noise(d, sigma0))

    def map_side(self, s: np.ndarray, sigma0: float) -> np.ndarray:
        """T^T N^-1 T s."""
        return self.data_side(self.transfer(s), sigma0)


def white(x: np.ndarray, sigma0: float) -> np.ndarray:
    return x / sigma0**2


def white_without_mean(x: np.ndarray, sigma0: float) -> np.ndarray:
    """White noise over an offset of each scan that nothing is known of."""
    return (x - x.mean()) / sigma0**2


def _over_scans(samples: DataFrame, keys: list[str], value: str, f: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """pix, psi and f of each detector-scan's values (its sigma0 is constant)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        return pdf[["pix", "psi"]].assign(v=f(pdf[value].to_numpy(float), float(pdf["sigma0"].iloc[0])))

    return samples.select(*keys, "i", "pix", "psi", "sigma0", value).groupBy(*keys).applyInPandas(run, "pix long, psi double, v double")


def _project_adjoint(values: DataFrame) -> DataFrame:
    return values.groupBy("pix").agg(*(F.sum(F.col("v") * p).alias(n) for n, p in zip(STOKES, stokes.response(F.col("psi")), strict=True)))


def right_side(samples: DataFrame, keys: list[str], model: ScanModel, value: str = "tod") -> DataFrame:
    """pix and P^T T^T N^-1 d as s_i, s_q, s_u."""
    return _project_adjoint(_over_scans(samples, keys, value, model.data_side))


def left_side(samples: DataFrame, keys: list[str], model: ScanModel, sky: DataFrame, npix: int) -> DataFrame:
    """pix and P^T T^T N^-1 T P m for the map *sky* (pix, s_i, s_q, s_u); pixels it lacks are 0."""
    signal = stokes.project(F.col("psi"), *(F.coalesce(n, F.lit(0.0)) for n in STOKES))
    seen = samples.select(*keys, "i", "pix", "psi", "sigma0").join(small(sky, npix), "pix", "left").withColumn("_s", signal)
    return _project_adjoint(_over_scans(seen, keys, "_s", model.map_side))


INVERSE = tuple(f"m{k}" for k in range(6))


def pixel_inverses(samples: DataFrame) -> DataFrame:
    """pix and the packed inverse of the matrix of white noise without a transfer function; a singular
    one has the inverse of its diagonal."""
    w = F.lit(1.0) / (F.col("sigma0") * F.col("sigma0"))
    sums = samples.groupBy("pix").agg(*normal_sums(w, F.col("psi")))
    a = [F.col(c) for c in PACKED]
    alone = [F.when(a[k] > 0, F.lit(1.0) / a[k]).otherwise(0.0) if k in (0, 3, 5) else F.lit(0.0) for k in range(6)]
    return sums.select("pix", *(F.coalesce(i, d).alias(n) for i, d, n in zip(linalg.inverse(a), alone, INVERSE, strict=True)))


def solve(samples: DataFrame, keys: list[str], model: ScanModel, npix: int, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """pix, s_i, s_q, s_u by conjugate gradients, from zero and with ``pixel_inverses`` as preconditioner;
    a direction that the samples say nothing of stays as it began.

    Vectors are checkpointed in the shared folder each iteration, which cuts their lineage and
    outlives executors.
    """
    vector = lambda n: [F.col(f"{n}{k}") for k in range(3)]
    named = lambda n, columns: [c.alias(f"{n}{k}") for k, c in enumerate(columns)]
    dot = lambda u, v: F.coalesce(F.sum(sum((a * b for a, b in zip(u, v, strict=True)), F.lit(0.0))), F.lit(0.0))
    inverse = [F.col(c) for c in INVERSE]
    b = right_side(samples, keys, model).select("pix", *(F.col(n).alias(f"r{k}") for k, n in enumerate(STOKES)))
    begin = b.join(pixel_inverses(samples), "pix")
    state = begin.select("pix", *INVERSE, *named("x", [F.lit(0.0)] * 3), *vector("r"), *named("p", linalg.multiply(inverse, vector("r")))).checkpoint()
    rz = first = state.agg(dot(vector("r"), vector("p"))).first()[0]
    for _ in range(most):
        if not first or rz <= tolerance**2 * first:
            break
        direction = state.select("pix", *(F.col(f"p{k}").alias(n) for k, n in enumerate(STOKES)))
        image = left_side(samples, keys, model, direction, npix).select("pix", *(F.col(n).alias(f"q{k}") for k, n in enumerate(STOKES)))
        joined = state.join(image, "pix").checkpoint()
        step = rz / joined.agg(dot(vector("p"), vector("q"))).first()[0]
        moved = joined.select("pix", *INVERSE, *named("x", [x + p * step for x, p in zip(vector("x"), vector("p"), strict=True)]), *named("r", [r - q * step for r, q in zip(vector("r"), vector("q"), strict=True)]), *vector("p"))
        z = linalg.multiply(inverse, vector("r"))
        new = moved.agg(dot(vector("r"), z)).first()[0]
        state, rz = moved.select("pix", *INVERSE, *vector("x"), *vector("r"), *named("p", [v + p * (new / rz) for v, p in zip(z, vector("p"), strict=True)])), new
    return state.select("pix", *(F.col(f"x{k}").alias(n) for k, n in enumerate(STOKES)))
