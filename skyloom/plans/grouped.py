"""Queries of the grouped operators: codecs, Fourier transforms, noise, driver solvers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions.spline import spinning_dust
from skyloom.operators import codec, dense, fourier, harmonics, noise, sampling, simulation
from skyloom.operators import mapmaking as mm
from skyloom.plans.registry import register
from skyloom.sources import driver_tables as t

KEYS = ["det_id", "scan_day"]


def _codes(spark, d):
    return t.timeline(spark, d).select(*KEYS, "i", F.floor("tod").alias("code"))


@register("COD-03 COD-04 COD-05 COD-06 COD-07 SNK-06", "det_id scan_day i value", "", "SELECT det_id, scan_day, i, CAST(floor(tod) AS BIGINT) AS value FROM timeline")
def huffman_round_trip(spark, d):
    x = _codes(spark, d)
    tree = codec.tree_of(x, "code")
    return codec.decode_scans(codec.encode_scans(x, KEYS, "code", tree), KEYS, tree)


@register("WIN-14 WIN-15 WIN-16 WIN-17", "det_id scan_day i", "value", "SELECT det_id, scan_day, i, tod AS value FROM timeline", 6)
def fourier_round_trip(spark, d):
    return fourier.scan_values(t.timeline(spark, d), KEYS, "tod", lambda x: fourier.irfft_mirrored(fourier.rfft_mirrored(x), len(x)))


@register("WIN-18 GAIN-03", "det_id scan_day i", "value", "SELECT det_id, scan_day, i, (tod - avg(tod) OVER (PARTITION BY det_id, scan_day))/4e0 AS value FROM timeline", 9)
def inverse_noise_white_limit(spark, d):
    """The Fourier path with a flat spectrum must agree with the algebra of white noise."""
    return fourier.scan_values(t.timeline(spark, d), KEYS, "tod", lambda x: fourier.inverse_noise(x, 1.0, lambda f: np.full(len(f), 4.0)))


@register("WIN-12 WIN-13", "det_id scan_day n", "power", "SELECT det_id, scan_day, count(*) AS n, sum(tod*tod) AS power FROM timeline GROUP BY 1, 2", 6)
def periodogram_power(spark, d):
    """Sums of the two-sided periodogram, which equal the sums of squares."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["tod"].to_numpy(float)
        _, p = fourier.periodogram(x, 1.0)
        both = np.full(len(p), 2.0)
        both[0] = 1.0
        if len(x) % 2 == 0:
            both[-1] = 1.0
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in KEYS} | {"n": [len(x)], "power": [float((both * p).sum())]})

    return fourier.over_scans(t.timeline(spark, d), KEYS, run, "det_id long, scan_day long, n long, power double")


@register("NOI-09 NOI-10 NOI-11 GAIN-03", "det_id scan_day i", "value")
def correlated_noise(spark, d):
    """Noise with a 1/f spectrum in every scan, its draws keyed by the scan."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["tod"].to_numpy(float)
        mask = (pdf["flag"].to_numpy() & 2) == 0
        rng = np.random.default_rng([int(pdf[k].iloc[0]) for k in KEYS])
        draws = (rng.standard_normal(len(x)), rng.standard_normal(len(x)), rng.random(4))
        return pdf[[*KEYS, "i"]].assign(value=noise.noise_step(x, mask.astype(float), 1.0, 25.0, 0.05, -1.5, draws).noise)

    return fourier.over_scans(t.timeline(spark, d), KEYS, run, "det_id long, scan_day long, i long, value double")


@register("NOI-06 NOI-07", "det_id scan_day", "sigma0 fknee alpha")
def noise_parameters(spark, d):
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["tod"].to_numpy(float)
        s = fourier.sigma_of_psd(x, 1.0, 0.1)
        fknee, alpha = noise.fitted_parameters(x - x.mean(), 1.0, s, 0.1, -1.0, np.full(10, 0.5), window=(0.02, 0.45), binned=True)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in KEYS} | {"sigma0": [s], "fknee": [fknee], "alpha": [alpha]})

    return fourier.over_scans(t.timeline(spark, d), KEYS, run, "det_id long, scan_day long, sigma0 double, fknee double, alpha double")


@register("GAIN-07", "det_id scan_id", "gain")
def gain_temporal(spark, d):
    import pandas as pd

    sums = t.samples(spark, d).where("flag = 0").groupBy("det_id", "scan_id").agg(F.sum(F.lit(1.0) / (F.col("sigma0") * F.col("sigma0"))).alias("a"), F.sum((F.col("tod") - 35.0) * 1e-2 / (F.col("sigma0") * F.col("sigma0"))).alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scan_id")
        f = np.fft.rfftfreq(len(pdf))
        prior = np.where(f > 0, 1e-4 * np.where(f > 0, f, 1.0) ** -2.5, 0.0)
        return pdf[["det_id", "scan_id"]].assign(gain=fourier.temporal_gain(pdf["a"].to_numpy(), pdf["b"].to_numpy(), prior))

    return sums.groupBy("det_id").applyInPandas(run, "det_id long, scan_id long, gain double")


@register("SEP-02 SEP-03 SEP-04 SEP-05 SEP-06 SEP-07 SEP-08 SEP-11 SHT-16 CGM-12 CMB-01", "comp l m", "re im")
def amplitude_solver(spark, d):
    """Two components over three bands of a small map, the mean solution; the joint preconditioner leads to it."""
    rows = t.samples(spark, d).where("flag = 0").groupBy("band", "pix").agg(F.avg("tod").alias("v"), F.count(F.lit(1)).alias("n")).collect()
    nside, lmax = t.NSIDE, 3
    bands = []
    for name in sorted({r.band for r in rows}):
        v, w = np.zeros(t.NPIX), np.zeros(t.NPIX)
        for r in rows:
            if r.band == name:
                v[r.pix], w[r.pix] = r.v, r.n / 400.0
        bands.append(sampling.Band(v, w, np.ones(lmax + 1)))
    mixing = np.array([[1.0, 3.0**-k] for k in range(len(bands))])
    a = sampling.AmplitudeSolver(bands, mixing, np.full((2, lmax + 1), 1e3), nside, lmax).solve(preconditioner="joint")
    out = [(c, ell, m, float(a[c, k].real), float(a[c, k].imag)) for c in range(2) for k, (ell, m) in enumerate(harmonics.pairs(lmax))]
    return spark.createDataFrame(out, "comp int, l int, m int, re double, im double")


@register("MC-01 MC-04 MC-06 MC-07", "name", "value")
def spectral_index_chain(spark, d):
    """A Metropolis chain whose likelihood needs four sums of the samples."""
    x = t.samples(spark, d).where("flag = 0").join(F.broadcast(t.bands(spark)), "band")
    rows = x.groupBy("nu").agg(F.avg("tod").alias("m"), (F.count(F.lit(1)) / F.var_samp("tod")).alias("w")).orderBy("nu").collect()
    nu, m, w = (np.array([float(r[k]) for r in rows]) for k in ("nu", "m", "w"))
    amp = float(m[0])
    views = [sampling.Parameter("sync", pol, "beta", -0.5, 0.05, -4.0, 1.0, (0.0, 1.0)) for pol in ("I", "QU")]
    groups = sampling.parameter_groups(views)  # one parameter for both views
    names = {k: ".".join(k) for k in groups}
    likelihood = lambda at: float(-0.5 * np.sum(w * (m - amp * (nu / nu[0]) ** at["sync.beta"]) ** 2))
    density = sampling.bounded(likelihood, {names[k]: (p.low, p.high) for k, p in groups.items()}, {names[k]: p.prior for k, p in groups.items() if p.prior})
    last, _, taken = sampling.metropolis({names[k]: p.value for k, p in groups.items()}, density, sampling.gaussian_step({names[k]: p.step for k, p in groups.items()}), 500, np.random.default_rng(5))
    return spark.createDataFrame([("beta", last["sync.beta"]), ("accepted", float(taken))], "name string, value double")


@register("LIN-09", "pix solved", "c0 c1", """WITH s AS (SELECT pix, sum(w) AS a, sum(w*m) AS b, sum(w*m*m) AS c, sum(w*d) AS y0, sum(w*m*d) AS y1 FROM
    (SELECT pix, d, 1e0/(rms*rms) AS w, pow(chan*1e0, -15e-1) AS m FROM channels) x GROUP BY pix)
    SELECT pix, a*c - b*b > 1e-12*a*c AS solved, (c*y0 - b*y1)/(a*c - b*b) AS c0, (a*y1 - b*y0)/(a*c - b*b) AS c1 FROM s""")
def components_by_cholesky(spark, d):
    mixing = [F.lit(1.0), F.pow(F.col("chan").cast("double"), F.lit(-1.5))]
    return dense.solve_rows(mm.mixing_sums(t.channels(spark, d), "pix", mixing, F.col("d"), F.lit(1.0) / (F.col("rms") * F.col("rms"))), "pix", 2)


@register("SIM-05 SIM-06 SIM-07 SIM-19 SIM-21", "det_id scan_day i", "tod")
def simulated_scans(spark, d):
    x = mm.with_sky(t.timeline(spark, d), t.sky(spark), t.NPIX)
    return simulation.simulate(x, KEYS, "signal", 1, 1.0, 0.5, 0.1, -1.5, 1.5, 2.0)


@register("SIM-04 SIM-05", "det_id scan_day n", "mean", "SELECT det_id, scan_day, count(*) AS n, 15e-1*avg(s_i + s_q*cos(2e0*psi) + s_u*sin(2e0*psi)) AS mean FROM timeline JOIN sky USING (pix) GROUP BY 1, 2", 6)
def simulated_means(spark, d):
    """Without noise and filter a scan is its gain times its signal."""
    x = mm.with_sky(t.timeline(spark, d), t.sky(spark), t.NPIX)
    out = simulation.simulate(x, KEYS, "signal", 1, 1.0, 0.0, 0.0, -1.0, 1.5)
    return out.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("tod").alias("mean"))


@register("SKY-06", "k", "sed")
def spinning_dust_spectrum(spark, d):
    table_nu = np.geomspace(1.0, 300.0, 60)
    table = (table_nu / 30) ** 2.5 * np.exp(-((table_nu / 30) ** 1.2))
    nu = np.arange(5.0, 205.0, 5.0)
    sed = spinning_dust(nu, 22.0, 25.0, table_nu, table, 30.0)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(sed)], "k int, sed double")
