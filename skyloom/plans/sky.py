"""Queries: spectra, units, beams, multipoles, sources, simulation, likelihoods."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import geometry as geo
from skyloom.functions import spectra as sp
from skyloom.operators.mapmaking import small
from skyloom.plans.registry import register
from skyloom.sources import driver_tables as t

HK = "(662607015e-42/1380649e-29)"
NU = "SELECT range AS k, 2e1 + range*5e0 AS nu FROM range(160)"


def _nu(spark: SparkSession) -> DataFrame:
    return spark.range(160).select(F.col("id").alias("k"), (F.col("id") * 5.0 + 20.0).alias("nu"))


GAUNT = "ln(exp(596e-2 - sqrt(3e0)/pi()*ln({nu}*pow(7e-1, -15e-1))) + exp(1e0))"


@register("SKY-01 SKY-02 SKY-03 SKY-04 SKY-05 SKY-28", "k", "cmb dust sync ff bb", f"""SELECT k, pow(x, 2)*exp(x)/pow(exp(x) - 1e0, 2) AS cmb,
    pow(nu/545e0, 255e-2)*(exp(1e9*{HK}/195e-1*545e0) - 1e0)/(exp(1e9*{HK}/195e-1*nu) - 1e0) AS dust, pow(nu/3e1, -31e-1) AS sync,
    pow(4e1/nu, 2)*{GAUNT.format(nu="nu")}/{GAUNT.format(nu="4e1")} AS ff,
    1e18*2e0*662607015e-42/pow(299792458e0, 2)*pow(nu*1e9, 3)/(exp(nu*1e9*{HK}/195e-1) - 1e0) AS bb FROM (SELECT k, nu, 1e9*{HK}/27255e-4*nu AS x FROM ({NU}) n) q""", 8)
def spectral_energy(spark, d):
    nu = F.col("nu")
    return _nu(spark).select(
        "k", sp.cmb(nu).alias("cmb"), sp.thermal_dust(nu, 545.0, 1.55, 19.5).alias("dust"), sp.synchrotron(nu, 30.0, -3.1).alias("sync"),
        sp.free_free(nu, 40.0, 7000.0).alias("ff"), (sp.blackbody(nu, 19.5) * 1e18).alias("bb"),
    )


@register("SKY-27", "band unit", "factor", f"""SELECT band, unit, CASE unit WHEN 'uK_RJ' THEN 1e0 WHEN 'mK_RJ' THEN 1e-3 WHEN 'K_RJ' THEN 1e-6 WHEN 'uK_CMB' THEN 1e0/p WHEN 'mK_CMB' THEN 1e-3/p WHEN 'K_CMB' THEN 1e-6/p
    ELSE 2e0*1380649e-29*pow(nu*1e9, 2)/pow(299792458e0, 2)*1e20*1e-6 END AS factor FROM (SELECT *, pow(x, 2)*exp(x)/pow(exp(x) - 1e0, 2) AS p FROM
    (SELECT band, nu, 1e9*{HK}/27255e-4*nu AS x FROM bands) b0) b CROSS JOIN (SELECT unnest(['uK_RJ', 'mK_RJ', 'K_RJ', 'uK_CMB', 'mK_CMB', 'K_CMB', 'MJy/sr']) AS unit) u""", 10)
def unit_factors(spark, d):
    units = spark.createDataFrame([(u,) for u in ("uK_RJ", "mK_RJ", "K_RJ", "uK_CMB", "mK_CMB", "K_CMB", "MJy/sr")], "unit string")
    return t.bands(spark).crossJoin(F.broadcast(units)).select("band", "unit", sp.unit_factor(F.col("nu"), F.col("unit")).alias("factor"))


@register("NOI-01 NOI-02 NOI-03 SIM-06", "k", "whole corr inverse", """SELECT k, CASE WHEN f = 0e0 THEN 4e0 ELSE 4e0*(1e0 + pow(f/5e-2, -14e-1)) END AS whole, CASE WHEN f = 0e0 THEN 0e0 ELSE 4e0*pow(f/5e-2, -14e-1) END AS corr,
    CASE WHEN f = 0e0 THEN 0e0 ELSE 1e0/(4e0*pow(f/5e-2, -14e-1)) END AS inverse FROM (SELECT range AS k, range*1e-2 AS f FROM range(200)) q""", 8)
def noise_spectra(spark, d):
    f = F.col("id") * 1e-2
    p = (F.lit(2.0), F.lit(0.05), F.lit(-1.4))
    return spark.range(200).select(F.col("id").alias("k"), sp.noise_full(f, *p).alias("whole"), sp.noise_corr(f, *p).alias("corr"), sp.inverse_or_zero(sp.noise_corr(f, *p)).alias("inverse"))


@register("NOI-04 MC-05", "k", "gauss logn flat", """SELECT k, CASE WHEN x < 1e-1 OR x > 3e0 THEN -1e30 ELSE -5e-1*pow((x - 1e0)/3e-1, 2) END AS gauss, CASE WHEN x < 1e-1 OR x > 3e0 THEN -1e30 ELSE -5e-1*pow(ln(x)/3e-1, 2) END AS logn,
    CASE WHEN x < 1e-1 OR x > 3e0 THEN -1e30 ELSE 0e0 END AS flat FROM (SELECT range AS k, 5e-2 + range*1e-1 AS x FROM range(40)) q""", 6)
def log_priors(spark, d):
    x = F.col("id") * 1e-1 + 5e-2
    return spark.range(40).select(
        F.col("id").alias("k"), sp.log_prior(x, "gaussian", 1.0, 0.3, 0.1, 3.0).alias("gauss"), sp.log_prior(x, "lognormal", 1.0, 0.3, 0.1, 3.0).alias("logn"), sp.log_prior(x, "gaussian", 1.0, 0.0, 0.1, 3.0).alias("flat")
    )


GRID = "SELECT range AS k, 1e-1 + range*2e-2 AS x, -5e-1*pow((1e-1 + range*2e-2 - 13e-1)/2e-1, 2) AS ll FROM range(150)"


@register("NOI-05", "draw", "x", f"""WITH g AS ({GRID}), p AS (SELECT k, x, sum(exp(ll - (SELECT max(ll) FROM g))) OVER (ORDER BY k) AS c FROM g),
    n AS (SELECT k, x, c/max(c) OVER () AS c FROM p), b AS (SELECT x, c, lag(x) OVER (ORDER BY k) AS x0, lag(c) OVER (ORDER BY k) AS c0 FROM n)
    SELECT draw, CASE WHEN c0 IS NULL THEN x ELSE x0 + (x - x0)*(u - c0)/(c - c0) END AS x FROM (SELECT range AS draw, (range + 5e-1)/5e1 AS u FROM range(50)) q
    JOIN b ON u <= c AND u > coalesce(c0, -1e0)""", 8)
def inversion_sampler(spark, d):
    w = Window.orderBy("k")  # one row a grid point, a fixed number
    x = F.col("id") * 2e-2 + 1e-1
    g = spark.range(150).select(F.col("id").alias("k"), x.alias("x"), (F.pow((x - 1.3) / 0.2, 2) * -0.5).alias("ll"))
    top = F.max("ll").over(Window.partitionBy(F.lit(1)))
    c = g.withColumn("p", F.exp(F.col("ll") - top)).withColumn("c", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("c", F.col("c") / F.max("c").over(Window.partitionBy(F.lit(1)))).withColumn("x0", F.lag("x").over(w)).withColumn("c0", F.lag("c").over(w))
    u = spark.range(50).select(F.col("id").alias("draw"), ((F.col("id") + 0.5) / 50.0).alias("u"))
    hit = u.join(F.broadcast(c), (F.col("u") <= F.col("c")) & (F.col("u") > F.coalesce("c0", F.lit(-1.0))))
    return hit.select("draw", F.when(F.col("c0").isNull(), F.col("x")).otherwise(F.col("x0") + (F.col("x") - F.col("x0")) * (F.col("u") - F.col("c0")) / (F.col("c") - F.col("c0"))).alias("x"))


@register("SIM-09 SIM-10", "k", "re im mre mim", """SELECT k, 1e0/(1e0 + w*w) AS re, -w/(1e0 + w*w) AS im, 75e-2/(1e0 + w*w) + 25e-2/(1e0 + 4e0*w*w) AS mre, -75e-2*w/(1e0 + w*w) - 25e-2*2e0*w/(1e0 + 4e0*w*w) AS mim
    FROM (SELECT range AS k, 2e0*pi()*range*1e-1*5e-2 AS w FROM range(100)) q""", 9)
def transfer_functions(spark, d):
    f = F.col("id") * 1e-1
    re, im = sp.single_pole(f, 0.05)
    mre, mim = sp.multi_pole(f, [3.0, 1.0], [0.05, 0.1])
    return spark.range(100).select(F.col("id").alias("k"), re.alias("re"), im.alias("im"), mre.alias("mre"), mim.alias("mim"))


SIG = "(3e1*pi()/180e0/6e1/sqrt(8e0*ln(2e0)))"


@register("SHT-14 SHT-20 SHT-21 SKY-13", "l", "beam profile radius prior", f"""SELECT l, exp(-5e-1*l*(l + 1e0)*{SIG}*{SIG}) AS beam, exp(-4e0*ln(2e0)*pow(l*5e-1/3e1, 2)) AS profile, 3e1/sqrt(8e0*ln(2e0))*sqrt(-2e0*ln(1e-2)) AS radius,
    d*CASE WHEN l = 0 THEN 1e0 ELSE 2e0*pi()/(m*(m + 1e0)) END AS prior FROM (SELECT l, m, 1e3*pow(m/8e1, -5e-1)*greatest(exp(-m*(m + 1e0)*{SIG}*{SIG}), 1e-10) AS d
    FROM (SELECT range AS l, greatest(range, 1)*1e0 AS m FROM range(300)) q0) q""", 8)
def beams_and_priors(spark, d):
    ell = F.col("id")
    return spark.range(300).select(
        ell.alias("l"), sp.beam_window(ell.cast("double"), 30.0).alias("beam"), sp.beam_profile(ell * 0.5, 30.0).alias("profile"), F.lit(sp.beam_radius(30.0, 1e-2)).alias("radius"),
        sp.prior_spectrum(ell, 1000.0, 80.0, -0.5, 30.0).alias("prior"),
    )


@register("SHT-06 SHT-07", "vec_id l m", "re im", f"SELECT vec_id, l, m, re*exp(-5e-1*l*(l + 1e0)*{SIG}*{SIG}*1e2) AS re, im*exp(-5e-1*l*(l + 1e0)*{SIG}*{SIG}*1e2) AS im FROM alm WHERE l > 2 AND l <= 6", 6)
def alm_filtered(spark, d):
    from skyloom.operators import multipoles as mp

    fl = spark.range(10).select(F.col("id").alias("l"), sp.beam_window(F.col("id").cast("double"), 300.0).alias("fl"))
    return mp.times(mp.project(t.alm(spark, d), 6).where("l > 2"), fl)


@register("SHT-08 SHT-09 SHT-22 SHT-24 SHT-25", "vec_id n", "dot", """SELECT a.vec_id, count(*) AS n, sum((CASE WHEN a.m = 0 THEN 1e0 ELSE 2e0 END)*(a.re*b.re + a.im*b.im)) AS dot FROM alm a JOIN
    (SELECT vec_id - 3 AS vec_id, l, m, re, im FROM alm) b ON a.vec_id = b.vec_id AND a.l = b.l AND a.m = b.m GROUP BY 1""", 5)
def alm_dot(spark, d):
    from skyloom.operators import multipoles as mp

    a = t.alm(spark, d)
    return mp.dot(a, a.withColumn("vec_id", F.col("vec_id") - 3), ["vec_id"])


@register("SHT-10 SHT-11 SHT-13", "vec_id n", "norm back", """SELECT vec_id, count(*) + count(CASE WHEN m > 0 THEN 1 END) AS n, sum(re*re*(CASE WHEN m = 0 THEN 1e0 ELSE 2e0 END) + 2e0*im*im) AS norm, sum(re + im) AS back FROM alm GROUP BY vec_id""", 5)
def alm_real_form(spark, d):
    from skyloom.operators import multipoles as mp

    real = mp.to_real(t.alm(spark, d))
    norm = real.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("norm"))
    return norm.join(mp.to_complex(real).groupBy("vec_id").agg(F.sum(F.col("re") + F.col("im")).alias("back")), "vec_id")


@register("SEP-06 SEP-09", "l", "pre beam", f"""SELECT l, 1e0/(1e0 + 1e1*sum(exp(-l*(l + 1e0)*pow(fwhm*pi()/180e0/6e1, 2)/(8e0*ln(2e0)))*pow(nu/1e2, -1e0))) AS pre, 1e0/sum(exp(-l*(l + 1e0)*pow(fwhm*pi()/180e0/6e1, 2)/(8e0*ln(2e0)))) AS beam
    FROM (SELECT range AS l FROM range(200)) q CROSS JOIN bands GROUP BY l""", 8)
def diagonal_preconditioner(spark, d):
    ell = F.col("l").cast("double")
    b2 = F.exp(ell * (ell + 1.0) * F.pow(F.col("fwhm") * (pi / 180 / 60), 2) * (-1.0 / (8.0 * 0.6931471805599453)))
    x = spark.range(200).toDF("l").crossJoin(F.broadcast(t.bands(spark)))
    return x.groupBy("l").agg((F.lit(1.0) / (F.sum(b2 / (F.col("nu") / 100.0)) * 10.0 + 1.0)).alias("pre"), (F.lit(1.0) / F.sum(b2)).alias("beam"))


PIXC = """SELECT range AS pix, CASE WHEN range < 4 THEN 1e0 - 1e0/12e0 WHEN range >= 44 THEN 1e0/12e0 - 1e0 ELSE 2e0*(2*2 - ((range - 4)//8 + 2))/6e0 END AS z,
    CASE WHEN range < 4 THEN (range + 5e-1)*pi()/2e0 WHEN range >= 44 THEN (range - 44 + 5e-1)*pi()/2e0 ELSE ((range - 4) % 8 + CASE WHEN ((range - 4)//8) % 2 = 0 THEN 5e-1 ELSE 0e0 END)*pi()/4e0 END AS phi FROM range(48)"""
HAV = "2e0*asin(sqrt(least(1e0, pow(sin((asin(z) - lat)/2e0), 2) + cos(lat)*cos(asin(z))*pow(sin((phi - lon)/2e0), 2))))"
BEAMS = f"SELECT *, exp(-4e0*ln(2e0)*pow(sep/6e-1, 2)) AS beam FROM (SELECT s.*, p.pix, {HAV} AS sep FROM sources s CROSS JOIN ({PIXC}) p) q WHERE sep <= 8e-1"


@register("SKY-07 SKY-08 SKY-09 SKY-10", "pix n", "value", f"SELECT pix, count(*) AS n, sum(amp*pow(1e2/3e1, alpha - 2e0)*beam) AS value FROM ({BEAMS}) b GROUP BY pix", 3)
def point_source_map(spark, d):
    from skyloom.operators import sources as so

    b = so.beams(t.sources(spark, d), t.NSIDE, 0.6, 0.8)
    return so.source_map(b, F.col("amp") * sp.radio_source(F.lit(100.0), 30.0, F.col("alpha")))


@register("SKY-11", "source n", "value", f"SELECT source, count(*) AS n, sum(beam*(1e1 + pix % 7)) AS value FROM ({BEAMS}) b GROUP BY source", 6)
def point_source_adjoint(spark, d):
    from skyloom.operators import sources as so

    b = so.beams(t.sources(spark, d), t.NSIDE, 0.6, 0.8)
    return so.source_values(b, t.sky(spark).select("pix", F.col("s_i").alias("value")))


@register("SKY-26 SIM-18 SIM-23", "band pix", "value", f"""SELECT band, pix, s_i*pow(nu/3e1, -31e-1) + 2e0*s_i*pow(nu/545e0, 255e-2)*(exp(1e9*{HK}/195e-1*545e0) - 1e0)/(exp(1e9*{HK}/195e-1*nu) - 1e0) + (s_q*s_q)*pow(1e9*{HK}/27255e-4*nu, 2)*exp(1e9*{HK}/27255e-4*nu)/pow(exp(1e9*{HK}/27255e-4*nu) - 1e0, 2) AS value
    FROM sky CROSS JOIN bands""", 6)
def sky_model_bands(spark, d):
    nu = F.col("nu")
    x = t.sky(spark).crossJoin(F.broadcast(t.bands(spark)))
    parts = F.array(F.col("s_i") * sp.synchrotron(nu, 30.0, -3.1), F.col("s_i") * 2.0 * sp.thermal_dust(nu, 545.0, 1.55, 19.5), F.col("s_q") * F.col("s_q") * sp.cmb(nu))
    return x.select("band", "pix", F.posexplode(parts).alias("comp", "v")).groupBy("band", "pix").agg(F.sum("v").alias("value"))


@register("SIM-01", "sample pix", "psi", "SELECT range AS sample, (range//40 % 6)*8 + CAST(floor((range % 40)/4e1*8e0) AS BIGINT) AS pix, pi()*((range % 40)/4e1) AS psi FROM range(120, 1000)", 9)
def raster_scan(spark, d):
    from skyloom.operators import simulation as sim

    x = sim.raster(spark, 120, 880, 40, 6)
    return x.select("sample", (F.col("row") * 8 + F.floor(F.col("frac") * 8)).alias("pix"), "psi")


@register("SIM-02", "sample", "x y z", """SELECT range AS sample, cos(13e-1)*cos(al) - sin(13e-1)*sin(be)*sin(al) AS x, cos(13e-1)*sin(al) + sin(13e-1)*sin(be)*cos(al) AS y, sin(13e-1)*cos(be) AS z
    FROM (SELECT range, 2e0*pi()*range/5e2 AS al, 2e0*pi()*range/6e1 AS be FROM range(500)) q""", 9)
def spinning_scan(spark, d):
    from skyloom.operators import simulation as sim

    return sim.spin(spark, 500, 500.0, 60.0, 1.3)


@register("SIM-11 SIM-12", "det_id scan_id", "mixed", """WITH m AS (SELECT det_id, scan_id, avg(tod) AS v FROM samples GROUP BY 1, 2)
    SELECT a.det_id, a.scan_id, sum(CASE WHEN a.det_id = b.det_id THEN b.v ELSE 1e-2*b.v END) AS mixed FROM m a JOIN m b ON a.scan_id = b.scan_id GROUP BY 1, 2""", 6)
def cross_talk(spark, d):
    from skyloom.operators import simulation as sim

    m = t.samples(spark, d).groupBy("det_id", "scan_id").agg(F.avg("tod").alias("v"))
    return sim.cross_talk(m, sim.cross_talk_matrix(spark, 4, 1e-2), ["scan_id"], "v")


@register("SIM-13", "band", "sigma0", "SELECT band, coalesce(CASE WHEN band = 'A' THEN 5e-1 END, CASE WHEN band = 'N' THEN 2e-1*sqrt(nu) END, 9e0) AS sigma0 FROM bands", 9)
def resolved_sigma(spark, d):
    fixed, per_root = F.when(F.col("band") == "A", 0.5), F.when(F.col("band") == "N", F.sqrt("nu") * 0.2)
    return t.bands(spark).select("band", F.coalesce(fixed, per_root, F.lit(9.0)).alias("sigma0"))


@register("SIM-15", "pix", "value", f"""SELECT DISTINCT p AS pix, 7e0 AS value FROM (SELECT CASE WHEN abs(z) <= 2e0/3e0 THEN 4 + (2 + jp - jm)*8 + (((jp + jm - 2 + (1 - ((3 + jp - jm) % 2)) + 1)//2 % 8) + 8) % 8
    WHEN z > 0e0 THEN 2*cr*(cr - 1) + CAST(floor(tt*cr) AS BIGINT) % (4*cr) ELSE 48 - 2*cr*(cr + 1) + CAST(floor(tt*cr) AS BIGINT) % (4*cr) END AS p FROM (SELECT *, CAST(floor(2e0*(5e-1 + tt) - 15e-1*z) AS BIGINT) AS jp,
    CAST(floor(2e0*(5e-1 + tt) + 15e-1*z) AS BIGINT) AS jm, CAST(floor((tt - floor(tt))*2e0*sqrt(3e0*(1e0 - abs(z)))) AS BIGINT) + CAST(floor((1e0 - tt + floor(tt))*2e0*sqrt(3e0*(1e0 - abs(z)))) AS BIGINT) + 1 AS cr
    FROM (SELECT cos(pi()/2e0 - (lat*2e1 - 71e0)*pi()/180e0) AS z, (lon*3e1 + 11e0)/9e1 AS tt FROM (SELECT range AS lon FROM range(12)) a CROSS JOIN (SELECT range AS lat FROM range(8)) b) c) e) f""")
def gridded_sources(spark, d):
    lon, lat = spark.range(12).select((F.col("id") * 30.0 + 11.0).alias("lon")), spark.range(8).select((F.col("id") * 20.0 - 71.0).alias("lat"))
    p = geo.ang2pix(2, F.lit(pi / 2) - F.radians("lat"), F.radians("lon"))
    return lon.crossJoin(F.broadcast(lat)).select(p.alias("pix")).distinct().withColumn("value", F.lit(7.0))


@register("SIM-17", "m", "re im", "SELECT * FROM (VALUES (0, sqrt(4e0*pi()/3e0)*3362e0*cos(1e0), 0e0), (1, -sqrt(2e0*pi()/3e0)*3362e0*sin(1e0)*cos(2e0), sqrt(2e0*pi()/3e0)*3362e0*sin(1e0)*sin(2e0))) v(m, re, im)", 6)
def solar_dipole_alm(spark, d):
    from math import cos, sin, sqrt

    a, th, ph = 3362.0, 1.0, 2.0
    rows = [(0, sqrt(4 * pi / 3) * a * cos(th), 0.0), (1, -sqrt(2 * pi / 3) * a * sin(th) * cos(ph), sqrt(2 * pi / 3) * a * sin(th) * sin(ph))]
    return spark.createDataFrame(rows, "m int, re double, im double")


@register("ORC-10", "band pix", "residual", """SELECT band, pix, avg(tod) - min(s_i) AS residual FROM samples JOIN sky USING (pix) WHERE flag = 0 GROUP BY 1, 2""", 5)
def map_residual(spark, d):
    m = t.samples(spark, d).where("flag = 0").groupBy("band", "pix").agg(F.avg("tod").alias("v"))
    return m.join(small(t.sky(spark), t.NPIX), "pix").select("band", "pix", (F.col("v") - F.col("s_i")).alias("residual"))
