"""Queries: filters, look-ups, binned maps, per-pixel solves, gains, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import linalg, stokes
from skyloom.operators import calibration as cal
from skyloom.operators import mapmaking as mm
from skyloom.plans.registry import register
from skyloom.sources import driver_tables as t

KEYS = ["band", "pix"]
SUMS = """sum(w) AS a_ii, sum(w*c) AS a_iq, sum(w*s) AS a_iu, sum(w*c*c) AS a_qq, sum(w*c*s) AS a_qu, sum(w*s*s) AS a_uu,
    sum(w*d) AS b_i, sum(w*d*c) AS b_q, sum(w*d*s) AS b_u, count(*) AS hits"""
TERMS = "SELECT *, 1e0/(sigma0*sigma0) AS w, cos(2e0*psi) AS c, sin(2e0*psi) AS s, tod AS d FROM samples WHERE flag = 0"
EQUATIONS = f"SELECT band, pix, {SUMS} FROM ({TERMS}) x GROUP BY band, pix"
DET = "(a_ii*(a_qq*a_uu-a_qu*a_qu) - a_iq*(a_iq*a_uu-a_qu*a_iu) + a_iu*(a_iq*a_qu-a_qq*a_iu))"
SOLVED = f"""SELECT band, pix, hits,
    CASE WHEN ok THEN ((a_qq*a_uu-a_qu*a_qu)*b_i + (a_iu*a_qu-a_iq*a_uu)*b_q + (a_iq*a_qu-a_iu*a_qq)*b_u)/det ELSE 0e0 END AS s_i,
    CASE WHEN ok THEN ((a_iu*a_qu-a_iq*a_uu)*b_i + (a_ii*a_uu-a_iu*a_iu)*b_q + (a_iq*a_iu-a_ii*a_qu)*b_u)/det ELSE 0e0 END AS s_q,
    CASE WHEN ok THEN ((a_iq*a_qu-a_iu*a_qq)*b_i + (a_iq*a_iu-a_ii*a_qu)*b_q + (a_ii*a_qq-a_iq*a_iq)*b_u)/det ELSE 0e0 END AS s_u,
    CASE WHEN ok THEN sqrt((a_qq*a_uu-a_qu*a_qu)/det) ELSE CAST('inf' AS DOUBLE) END AS rms_i,
    CASE WHEN ok THEN sqrt((a_ii*a_uu-a_iu*a_iu)/det) ELSE CAST('inf' AS DOUBLE) END AS rms_q,
    CASE WHEN ok THEN sqrt((a_ii*a_qq-a_iq*a_iq)/det) ELSE CAST('inf' AS DOUBLE) END AS rms_u
    FROM (SELECT *, {DET} AS det, a_ii*a_qq*a_uu > 1e-300 AND {DET} > 1e-12*a_ii*a_qq*a_uu AS ok FROM ({{}}) e) f"""
SIX = "s_i s_q s_u rms_i rms_q rms_u"


def _w() -> Column:
    """White-noise weight of a sample."""
    return F.lit(1.0) / (F.col("sigma0") * F.col("sigma0"))


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.samples(spark, sf_dir).where(mm.good(F.col("flag"), 1))


def _with_gain(spark: SparkSession, df: DataFrame) -> DataFrame:
    return df.join(mm.small(t.gains(spark), 4), "det_id").withColumn("g", F.col("g_abs") + F.col("g_rel"))


@register("FLT-01 FLT-03 AGG-03 AGG-05 AGG-10 AGG-11 LIN-01 LIN-02 LIN-03 LIN-05 LIN-06 AGG-12 LIN-07", "band pix hits", SIX, SOLVED.format(EQUATIONS))
def map_iqu_binned(spark, d):
    return mm.solve_maps(mm.normal_equations(_good(spark, d), KEYS, _w(), F.col("tod")), KEYS)


@register("LIN-01 LIN-03 LIN-08", "band pix hits", SIX, SOLVED.format(EQUATIONS.replace("WHERE flag = 0", "WHERE det_id = 1 AND pix % 5 = 0 AND psi < 1e-1")))
def map_iqu_singular(spark, d):
    few = t.samples(spark, d).where((F.col("det_id") == 1) & (F.col("pix") % 5 == 0) & (F.col("psi") < 1e-1))
    return mm.solve_maps(mm.normal_equations(few, KEYS, _w(), F.col("tod")), KEYS)


RESPONSE = TERMS.replace("cos(2e0*psi) AS c, sin(2e0*psi) AS s", "(1e0 + det_id*1e-1) AS ri, (1e0 - det_id*5e-2)*cos(2e0*psi) AS c, (1e0 - det_id*5e-2)*sin(2e0*psi) AS s")


@register(
    "AGG-04 AGG-06 GEO-11",
    "band pix",
    "a_ii a_iq a_uu b_i b_q b_u",
    f"SELECT band, pix, sum(w*ri*ri) AS a_ii, sum(w*ri*c) AS a_iq, sum(w*s*s) AS a_uu, sum(w*d*ri) AS b_i, sum(w*d*c) AS b_q, sum(w*d*s) AS b_u FROM ({RESPONSE}) x GROUP BY band, pix",
    6,
)
def map_detector_response(spark, d):
    return mm.normal_equations(_good(spark, d), KEYS, _w(), F.col("tod"), F.col("det_id") * 1e-1 + 1.0, F.lit(1.0) - F.col("det_id") * 5e-2)


@register(
    "AGG-01 AGG-02 AGG-07 AGG-08 AGG-09 AGG-15 CGM-08",
    "band pix hits",
    "s_i rms_i",
    f"SELECT band, pix, count(*) AS hits, sum(w*d)/sum(w) AS s_i, 1e0/sqrt(sum(w)) AS rms_i FROM ({TERMS}) x GROUP BY band, pix",
)
def map_intensity(spark, d):
    return mm.intensity_map(_good(spark, d), KEYS, _w(), F.col("tod"))


@register(
    "AGG-13",
    "pix hits",
    "s_i rms_i",
    f"""SELECT p.pix, coalesce(hits, 0) AS hits, coalesce(s_i, 0e0) AS s_i, coalesce(rms_i, CAST('inf' AS DOUBLE)) AS rms_i FROM (SELECT range AS pix FROM range(192)) p LEFT JOIN
    (SELECT pix, count(*) AS hits, sum(w*d)/sum(w) AS s_i, 1e0/sqrt(sum(w)) AS rms_i FROM ({TERMS}) x GROUP BY pix) m ON p.pix = m.pix""",
)
def map_full_sky(spark, d):
    """A sky of more pixels than the samples see."""
    part = mm.intensity_map(_good(spark, d), ["pix"], _w(), F.col("tod"))
    return mm.full_sky(part, spark.range(4 * t.NPIX).toDF("pix"), {"hits": 0, "s_i": 0.0, "rms_i": float("inf")})


@register("AGG-14 JOIN-08 JOIN-09 JOIN-10", "band pix local", "", "SELECT band, pix, dense_rank() OVER (PARTITION BY band ORDER BY pix) - 1 AS local FROM (SELECT DISTINCT band, pix FROM samples WHERE flag = 0)")
def pixel_domain(spark, d):
    return mm.pixel_index(_good(spark, d), ["band"], t.NPIX, 8)


@register("JOIN-11 JOIN-14", "pix", "s_i", "SELECT s.pix, s_i FROM sky s WHERE EXISTS (SELECT 1 FROM samples x WHERE x.pix = s.pix AND flag = 1)")
def sky_of_observed_pixels(spark, d):
    seen = t.samples(spark, d).where("flag = 1").select("pix").distinct()
    return t.sky(spark).join(seen, "pix", "left_semi")


SIGNAL = "s_i + s_q*cos(2e0*psi) + s_u*sin(2e0*psi)"


@register(
    "JOIN-01 JOIN-04 JOIN-07 CGM-09 SIM-04",
    "band det_id n",
    "mean total",
    f"SELECT band, det_id, count(*) AS n, avg({SIGNAL}) AS mean, sum(tod*({SIGNAL})) AS total FROM samples JOIN sky USING (pix) GROUP BY band, det_id",
    3,
)
def sky_signal(spark, d):
    s = mm.with_sky(t.samples(spark, d), t.sky(spark), t.NPIX)
    return s.groupBy("band", "det_id").agg(F.count(F.lit(1)).alias("n"), F.avg("signal").alias("mean"), F.sum(F.col("tod") * F.col("signal")).alias("total"))


@register(
    "JOIN-02 JOIN-03 JOIN-06 CGM-07",
    "band",
    "qu only_i",
    "SELECT band, avg(s_q*cos(2e0*psi) + s_u*sin(2e0*psi)) AS qu, avg(s_i) AS only_i FROM samples JOIN sky USING (pix) GROUP BY band",
)
def sky_signal_parts(spark, d):
    s = mm.with_sky(t.samples(spark, d), t.sky(spark), t.NPIX, (None, "s_q", "s_u"), "qu")
    s = s.withColumn("only_i", stokes.project(F.col("psi"), F.col("s_i")))
    return s.groupBy("band").agg(F.avg("qu").alias("qu"), F.avg("only_i").alias("only_i"))


@register(
    "FLT-02 SRC-09",
    "band keep n",
    "mean",
    """SELECT band, coalesce(m.keep, k.keep, true) AS keep, count(*) AS n, avg(tod) AS mean FROM samples s
    LEFT JOIN (SELECT * FROM mask WHERE pix < 20) m ON s.pix = m.pix LEFT JOIN (SELECT pix, pix % 2 = 0 AS keep FROM pixels WHERE pix < 40) k ON s.pix = k.pix GROUP BY 1, 2""",
)
def processing_masks(spark, d):
    named = t.mask(spark).where("pix < 20")
    default = spark.range(40).select(F.col("id").alias("pix"), (F.col("id") % 2 == 0).alias("keep"))
    return mm.masked(t.samples(spark, d), t.NPIX, named, default).groupBy("band", "keep").agg(F.count(F.lit(1)).alias("n"), F.avg("tod").alias("mean"))


@register(
    "FLT-05 FLT-06 FLT-07 FLT-04",
    "band det_id scan_id",
    "residual calibrated",
    f"""SELECT band, det_id, scan_id, avg(tod - (g_abs + g_rel)*({SIGNAL})) AS residual, avg(tod/(g_abs + g_rel)) AS calibrated
    FROM samples JOIN sky USING (pix) JOIN gains USING (det_id) WHERE flag = 0 GROUP BY 1, 2, 3""",
)
def gain_subtracted(spark, d):
    s = _with_gain(spark, mm.with_sky(_good(spark, d), t.sky(spark), t.NPIX))
    zero_safe = F.when(F.col("g") != 0, F.col("g")).otherwise(F.raise_error(F.lit("a gain is zero")).cast("double"))
    return s.groupBy("band", "det_id", "scan_id").agg(F.avg(F.col("tod") - F.col("g") * F.col("signal")).alias("residual"), F.avg(F.col("tod") / zero_safe).alias("calibrated"))


@register(
    "AGG-16 LIN-13",
    "band pix",
    "rms_i rms_qq rms_uu",
    f"""SELECT band, pix, 1e0/sqrt(a_ii) AS rms_i, CASE WHEN q > 1e-12*a_qq*a_uu THEN sqrt(a_uu/q) ELSE CAST('nan' AS DOUBLE) END AS rms_qq,
    CASE WHEN q > 1e-12*a_qq*a_uu THEN sqrt(a_qq/q) ELSE CAST('nan' AS DOUBLE) END AS rms_uu FROM (SELECT *, a_qq*a_uu - a_qu*a_qu AS q FROM ({EQUATIONS}) e) f""",
)
def noise_rms_by_polarization(spark, d):
    e = mm.normal_equations(_good(spark, d), KEYS, _w(), F.col("tod"))
    q = F.col("a_qq") * F.col("a_uu") - F.col("a_qu") * F.col("a_qu")
    ok, nan = q > F.col("a_qq") * F.col("a_uu") * linalg.SINGULAR, F.lit(float("nan"))
    qs = F.when(ok, q)
    return e.select(*KEYS, (F.lit(1.0) / F.sqrt("a_ii")).alias("rms_i"), F.coalesce(F.sqrt(F.col("a_uu") / qs), nan).alias("rms_qq"), F.coalesce(F.sqrt(F.col("a_qq") / qs), nan).alias("rms_uu"))


ETA = "(((det_id*7 + scan_id*13 + pix*29) % 101) - 5e1)/29e0"


@register(
    "AGG-17 LIN-14 SIM-07",
    "band pix",
    "n_i n_q n_u",
    f"SELECT band, pix, sum(w*e) AS n_i, sum(w*e*c) AS n_q, sum(w*e*s) AS n_u FROM (SELECT *, {ETA}*sigma0 AS e FROM ({TERMS}) x) y GROUP BY band, pix",
)
def noise_map_rhs(spark, d):
    eta = ((F.col("det_id") * 7 + F.col("scan_id") * 13 + F.col("pix") * 29) % 101 - 50.0) / 29.0 * F.col("sigma0")
    return _good(spark, d).groupBy(*KEYS).agg(*mm.rhs_sums(_w(), eta, F.col("psi"), names=("n_i", "n_q", "n_u")))


@register(
    "LIN-04 CGM-14 CGM-15 SHT-15",
    "band pix",
    "y_i y_q y_u",
    f"""SELECT band, e.pix, a_ii*s_i + a_iq*s_q + a_iu*s_u AS y_i, a_iq*s_i + a_qq*s_q + a_qu*s_u AS y_q, a_iu*s_i + a_qu*s_q + a_uu*s_u AS y_u
    FROM ({EQUATIONS}) e JOIN sky USING (pix)""",
)
def matrix_times_sky(spark, d):
    e = mm.normal_equations(_good(spark, d), KEYS, _w(), F.col("tod")).join(mm.small(t.sky(spark), t.NPIX), "pix")
    y = linalg.multiply([F.col(c) for c in mm.PACKED], [F.col(c) for c in ("s_i", "s_q", "s_u")])
    return e.select(*KEYS, *(v.alias(n) for v, n in zip(y, ("y_i", "y_q", "y_u"), strict=True)))


@register("CGM-03 CGM-11", "band pix", "s_i s_q s_u", SOLVED.format(EQUATIONS), 4)
def map_conjugate_gradient(spark, d):
    from skyloom.sources.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return mm.conjugate_gradient(_good(spark, d), KEYS, _w(), F.col("tod"))


@register(
    "FLT-03",
    "band pix hits",
    "s_i",
    f"""WITH st AS (SELECT band, det_id, scan_id, avg(CASE WHEN flag = 0 THEN 1e0 ELSE 0e0 END) AS gf FROM samples GROUP BY 1, 2, 3)
    SELECT x.band, x.pix, count(*) AS hits, sum(w*d)/sum(w) AS s_i FROM ({TERMS}) x JOIN st ON x.band = st.band AND x.det_id = st.det_id AND x.scan_id = st.scan_id
    WHERE gf >= 82e-2 GROUP BY 1, 2""",
)
def map_of_selected_scans(spark, d):
    keys = ["band", "det_id", "scan_id"]
    s = t.samples(spark, d)
    good = s.groupBy(*keys).agg(F.avg((F.col("flag") == 0).cast("double")).alias("gf")).where("gf >= 0.82")
    return mm.intensity_map(s.where("flag = 0").join(good, keys, "left_semi"), KEYS, _w(), F.col("tod"))


@register(
    "GAIN-01 GAIN-04",
    "band",
    "gain",
    f"""SELECT band, sum(sg*w*tod)/sum(sg*w*sg) + 5e-1/sqrt(sum(sg*w*sg)) AS gain FROM (SELECT band, tod, {SIGNAL} AS sg, 1e0/(sigma0*sigma0) AS w
    FROM samples JOIN sky USING (pix) WHERE flag = 0) x GROUP BY band""",
    8,
)
def gain_absolute(spark, d):
    s = mm.with_sky(_good(spark, d), t.sky(spark), t.NPIX)
    return cal.absolute_gain(cal.fit_sums(s, ["band"], F.col("signal"), F.col("tod"), _w()), ["band"], F.lit(1.0), F.lit(0.5))


@register(
    "GAIN-05 GAIN-06",
    "band det_id",
    "gain",
    f"""WITH f AS (SELECT band, det_id, sum(sg*w*tod) AS r, sum(sg*w*sg) AS d FROM (SELECT band, det_id, tod, {SIGNAL} AS sg, 1e0/(sigma0*sigma0) AS w
    FROM samples JOIN sky USING (pix) WHERE flag = 0) x GROUP BY 1, 2)
    SELECT band, det_id, (r - sum(r/d) OVER (PARTITION BY band)/sum(1e0/d) OVER (PARTITION BY band))/d AS gain FROM f""",
    8,
)
def gain_relative(spark, d):
    s = mm.with_sky(_good(spark, d), t.sky(spark), t.NPIX)
    return cal.relative_gain(cal.fit_sums(s, ["band", "det_id"], F.col("signal"), F.col("tod"), _w()), ["band"], "det_id", F.lit(0.0), F.lit(0.0))


@register(
    "SRC-18",
    "det_id scan_id",
    "g_abs g_rel g_temp",
    """WITH g AS (SELECT det_id, scan_id, avg(tod)/1e1 AS g FROM samples GROUP BY 1, 2), h AS (SELECT *, avg(g) OVER () AS g_abs, avg(g) OVER (PARTITION BY det_id) AS gd FROM g)
    SELECT det_id, scan_id, g_abs, gd - g_abs AS g_rel, g - gd AS g_temp FROM h""",
    6,
)
def gain_decomposition(spark, d):
    g = t.samples(spark, d).groupBy("det_id", "scan_id").agg((F.avg("tod") / 10.0).alias("g"))
    return cal.decompose_gains(g, "det_id", "g")


@register("GAIN-09", "det_id factor", "", "SELECT det_id, greatest(1, CAST(round_even(det_id*125e-2 + 5e-1, 0) AS BIGINT)) AS factor FROM gains")
def gain_downsample_factor(spark, d):
    return t.gains(spark).select("det_id", F.greatest(F.lit(1).cast("long"), F.bround(F.col("det_id") * 1.25 + 0.5, 0).cast("long")).alias("factor"))


STATS = """SELECT band, det_id, scan_id, count(CASE WHEN flag = 0 THEN 1 END) AS n, avg(CASE WHEN flag = 0 THEN 1e0 ELSE 0e0 END) AS gf,
    (sum(CASE WHEN flag = 0 THEN pow((tod - 35e0)/(sigma0*2e1), 2) END) - count(CASE WHEN flag = 0 THEN 1 END))/sqrt(2e0*count(CASE WHEN flag = 0 THEN 1 END)) AS z FROM samples GROUP BY 1, 2, 3"""


def _stats(spark, d):
    from skyloom.operators.timelines import chisq_z

    return chisq_z(t.samples(spark, d), ["band", "det_id", "scan_id"], F.col("tod") - 35.0, F.col("flag") == 0, F.col("sigma0") * 20.0)


@register("WIN-19", "band det_id scan_id n", "gf z", STATS)
def scan_chisq(spark, d):
    return _stats(spark, d).withColumnsRenamed({"good_fraction": "gf", "chisq_z": "z"})


@register(
    "AGG-18",
    "band present accepted low_fraction bad_chisq",
    "p5 p50 p95 worst",
    f"""SELECT band, count(*) AS present, count(CASE WHEN gf >= 82e-2 AND abs(z) <= 5e0 THEN 1 END) AS accepted, count(CASE WHEN gf < 82e-2 THEN 1 END) AS low_fraction,
    count(CASE WHEN gf >= 82e-2 AND abs(z) > 5e0 THEN 1 END) AS bad_chisq, quantile_cont(abs(z), 5e-2) AS p5, quantile_cont(abs(z), 5e-1) AS p50,
    quantile_cont(abs(z), 95e-2) AS p95, max(abs(z)) AS worst FROM ({STATS}) st GROUP BY band""",
)
def selection_summary(spark, d):
    return cal.selection_counts(_stats(spark, d), ["band"], 0.82, 5.0)


@register(
    "SEL-03 SEL-04",
    "det_id n",
    "median spread",
    f"""WITH st AS ({STATS}), m AS (SELECT det_id, z, median(z) OVER (PARTITION BY det_id) AS md FROM st)
    SELECT det_id, count(z) AS n, min(md) AS median, CASE WHEN count(z) >= 10 AND median(abs(z - md)) > 0 THEN 14826e-4*median(abs(z - md)) ELSE CAST('inf' AS DOUBLE) END AS spread FROM m GROUP BY det_id""",
)
def selection_mad(spark, d):
    return cal.median_mad(_stats(spark, d), ["det_id"], "chisq_z")


@register(
    "AGG-19 AGG-20",
    "band n",
    "lo p1 mean p99 hi",
    "SELECT band, count(tod) AS n, min(tod) AS lo, quantile_cont(tod, 1e-2) AS p1, avg(tod) AS mean, quantile_cont(tod, 99e-2) AS p99, max(tod) AS hi FROM samples GROUP BY band",
)
def distribution_summary(spark, d):
    x = F.when(~F.isnan("tod"), F.col("tod"))
    return t.samples(spark, d).groupBy("band").agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.percentile(x, F.lit(0.01)).alias("p1"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.99)).alias("p99"), F.max(x).alias("hi")
    )


@register(
    "AGG-21 MC-02 MC-03",
    "band ndof",
    "chi2 loglike mean_z",
    f"""SELECT band, count(*) AS ndof, sum(z*z) AS chi2, -5e-1*sum(z*z) AS loglike, avg(abs(z)) AS mean_z FROM (SELECT band, (tod - ({SIGNAL}))/(sigma0*2e1) AS z
    FROM samples JOIN sky USING (pix) WHERE flag = 0) x GROUP BY ROLLUP (band)""",
)
def chisq_rollup(spark, d):
    z = (F.col("tod") - F.col("signal")) / (F.col("sigma0") * 20.0)
    s = mm.with_sky(_good(spark, d), t.sky(spark), t.NPIX).withColumn("z", z)
    return s.rollup("band").agg(F.count(F.lit(1)).alias("ndof"), F.sum(F.col("z") * F.col("z")).alias("chi2"), (F.sum(F.col("z") * F.col("z")) * -0.5).alias("loglike"), F.avg(F.abs("z")).alias("mean_z"))


@register(
    "LIN-10 SEP-01",
    "pix",
    "c0 c1",
    """WITH s AS (SELECT pix, sum(w) AS a, sum(w*m) AS b, sum(w*m*m) AS c, sum(w*d) AS y0, sum(w*m*d) AS y1 FROM
    (SELECT pix, d, 1e0/(rms*rms) AS w, pow(chan*1e0, -15e-1) AS m FROM channels) x GROUP BY pix)
    SELECT pix, CASE WHEN a*c - b*b > 1e-12*a*c THEN (c*y0 - b*y1)/(a*c - b*b) ELSE 0e0 END AS c0,
    CASE WHEN a*c - b*b > 1e-12*a*c THEN (a*y1 - b*y0)/(a*c - b*b) ELSE 0e0 END AS c1 FROM s""",
)
def components_per_pixel(spark, d):
    mixing = [F.lit(1.0), F.pow(F.col("chan").cast("double"), F.lit(-1.5))]
    return mm.solve_two(mm.mixing_sums(t.channels(spark, d), "pix", mixing, F.col("d"), F.lit(1.0) / (F.col("rms") * F.col("rms"))), "pix")


@register("JOIN-12 JOIN-13 JOIN-15 FLT-09", "band view sender", "", """SELECT b.band, v.view, coalesce(i.band || '_I', q.band || '_QU') AS sender FROM bands b CROSS JOIN (SELECT unnest(['I', 'QU']) AS view) v
    LEFT JOIN (SELECT band FROM bands WHERE nu < 2e2) i ON i.band = b.band LEFT JOIN (SELECT band FROM bands WHERE nu > 5e1) q ON q.band = b.band
    WHERE NOT (v.view = 'QU' AND i.band IS NOT NULL)""")
def band_views(spark, d):
    b = t.bands(spark)
    views = b.select("band", F.explode(F.array(F.lit("I"), F.lit("QU"))).alias("view"))
    i = b.where("nu < 200").select("band", F.concat("band", F.lit("_I")).alias("i"))
    q = b.where("nu > 50").select("band", F.concat("band", F.lit("_QU")).alias("q"))
    out = views.join(F.broadcast(i), "band", "left").join(F.broadcast(q), "band", "left")
    return out.where(~((F.col("view") == "QU") & F.col("i").isNotNull())).select("band", "view", F.coalesce("i", "q").alias("sender"))


@register("SRC-10", "scan_id n good", "", """WITH n AS (SELECT scan_id, count(*) AS n FROM samples GROUP BY scan_id), f AS (SELECT range AS n, (range*7919) % 1009 AS cost FROM range(200000))
    SELECT s.scan_id, s.n, arg_min(f.n, f.cost*1000000 + f.n) AS good FROM n s JOIN f ON f.n BETWEEN CAST(ceil(s.n*99e-2) AS BIGINT) AND s.n GROUP BY 1, 2""")
def fourier_lengths(spark, d):
    n = t.samples(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    # each count meets its own range only, made beside it instead of by a range join
    tries = n.withColumn("f", F.explode(F.sequence(F.ceil(F.col("n") * 0.99), F.col("n"))))
    return tries.groupBy("scan_id", "n").agg(F.min_by("f", F.col("f") * 7919 % 1009 * 1000000 + F.col("f")).alias("good"))
