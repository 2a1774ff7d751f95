"""Queries of scan files, sinks, jumps, operators on whole scans and the Gibbs half-steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import geometry as geo
from skyloom.operators import calibration as cal
from skyloom.operators import components as comp
from skyloom.operators import gibbs, harmonics, noise, simulation, unbinned
from skyloom.operators import fourier
from skyloom.operators import mapmaking as mm
from skyloom.operators import timelines as tl
from skyloom.plans.maps import SIGNAL
from skyloom.plans.maps import SUMS as EQUATION_SUMS
from skyloom.plans.registry import register
from skyloom.plans.timeline import CENTRE, ISLANDS, PIX
from skyloom.sources import driver_tables as t
from skyloom.sources import layouts, parameters, readers, sinks
from skyloom.sources.session import shared_path

KEYS = ["det_id", "scan_day"]
SCAN = "scan_id det_id n"
VALUES = "pix_sum psi_sum tod_mean gain"


def _scan_samples(spark, d):
    """The timeline as samples of one band; gains differ by detector."""
    x = t.timeline(spark, d)
    return x.select(F.lit("A").alias("band"), F.col("scan_day").alias("scan_id"), "det_id", "i", "tod", "pix", "psi", "flag", (F.col("det_id") * 40.0 + 10.0).alias("gain"), (F.col("det_id") + 1.0).alias("sigma0"))


def _files(spark, d) -> str:
    path = shared_path(spark, "scans")
    layouts.write_scans(_scan_samples(spark, d), path, t.NSIDE, 4096, 1.0)
    return path


def _summary(samples):
    return samples.groupBy("scan_id", "det_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pix").alias("pix_sum"), F.sum("psi").alias("psi_sum"), F.avg("tod").alias("tod_mean"), F.max("gain").alias("gain")
    )


# what a scan file holds: float samples, angles in bins
FILE = """f AS (SELECT scan_day AS scan_id, det_id, i, CAST(CAST(tod AS FLOAT) AS DOUBLE) AS tod, round_even(tod, 0) AS whole, pix, round_even(psi*4096e0/(2e0*pi()), 0)*2e0*pi()/4096e0 AS psi, flag,
    1e1 + 4e1*det_id AS gain, count(*) OVER (PARTITION BY det_id, scan_day) AS ntod FROM timeline)"""
SUMS = "count(*) AS n, CAST(sum(pix) AS BIGINT) AS pix_sum, sum(psi) AS psi_sum, avg({x}) AS tod_mean, max(gain){g} AS gain"


@register("SRC-01 SRC-02 SRC-10 SNK-06", SCAN, VALUES, f"""WITH {FILE} SELECT scan_id, det_id, {SUMS.format(x="tod", g="*1e-6")} FROM f WHERE i < ntod - ntod % 4 AND scan_id % 7 <> 3 GROUP BY 1, 2
    HAVING avg(CASE WHEN (flag & 2) = 0 THEN 1e0 ELSE 0e0 END) >= 75e-2 AND avg(abs(tod)) <= 5e1 AND stddev_pop(tod) <= 5e1""", 6)
def satellite_scans(spark, d):
    """Cuts by size, spread, flags and a list of bad scans, on scans cut to a good length."""
    x = _scan_samples(spark, d)
    counts = x.groupBy("scan_id", "det_id").agg(F.count(F.lit(1)).alias("ntod")).select("ntod").distinct()
    good = counts.select("ntod", (F.col("ntod") - F.col("ntod") % 4).alias("good"))
    bad = x.select("scan_id").distinct().where("scan_id % 7 = 3")
    return _summary(readers.read_samples("satellite", spark, _files(spark, d), bits=2, largest=50.0, bad_scans=bad, fourier_lengths=good))


@register("SRC-03", SCAN, VALUES, f"""WITH {FILE}, e AS (SELECT min(scan_id) + 5 AS a, max(scan_id) - 5 AS b FROM f)
    SELECT scan_id, det_id, {SUMS.format(x="whole", g="")} FROM f, e WHERE gain <= 1e2 AND scan_id BETWEEN a AND b GROUP BY 1, 2 HAVING avg(CASE WHEN i % (CASE WHEN scan_id % 2 = 0 THEN 5 ELSE 20 END) = 0 THEN 0e0 ELSE 1e0 END) >= 9e-1""", 6)
def ground_scans(spark, d):
    """Coded timelines, a range that includes its last scan, cuts by gain and by a bit that every second scan has too often."""
    lo, hi = t.timeline(spark, d).agg(F.min("scan_day") + 5, F.max("scan_day") - 5).first()
    often = F.when(F.col("scan_id") % 2 == 0, 5).otherwise(20)
    path = shared_path(spark, "scans")
    marked = F.when(F.col("i") % often == 0, F.col("flag") + 4).otherwise(F.col("flag")).cast("int")
    layouts.write_scans(_scan_samples(spark, d).withColumn("flag", marked), path, t.NSIDE, 4096, 1.0, coded_tod=True)
    return _summary(readers.read_samples("ground", spark, path, bits=4, first=lo, last=hi))


@register("SRC-05", SCAN, VALUES, f"""WITH {FILE} SELECT scan_id, det_id, {SUMS.format(x="tod", g="").replace("sum(psi)", "0e0")} FROM f GROUP BY 1, 2
    HAVING avg(CASE WHEN (flag & 3) = 0 THEN 1e0 ELSE 0e0 END) >= 5e-1""", 6)
def infrared_scans(spark, d):
    return _summary(readers.read_samples("infrared", spark, _files(spark, d), bits=3))


@register("SRC-06", SCAN, VALUES, f"""WITH {FILE}, bad AS (SELECT DISTINCT scan_id FROM f WHERE pix = 7 AND det_id = 2)
    SELECT scan_id, det_id, {SUMS.format(x="tod", g="")} FROM f WHERE scan_id NOT IN (SELECT scan_id FROM bad) GROUP BY 1, 2""", 6)
def simulated_satellite_scans(spark, d):
    """A bit that a few samples of one detector have rejects their scans for all detectors."""
    path = shared_path(spark, "scans")
    marked = F.when((F.col("pix") == 7) & (F.col("det_id") == 2), F.col("flag") + 8).otherwise(F.col("flag")).cast("int")
    layouts.write_scans(_scan_samples(spark, d).withColumn("flag", marked), path, t.NSIDE, 4096, 1.0)
    return _summary(readers.read_samples("simulated_satellite", spark, path, bits=8))


@register("SRC-07", "det_id n", "psi_sum", f"WITH {FILE} SELECT det AS det_id, count(*) AS n, sum(psi + radians(225e-1*(det % 8))) AS psi_sum FROM f CROSS JOIN (SELECT range AS det FROM range(10)) GROUP BY 1", 4)
def spawned_detectors(spark, d):
    x = readers.read_samples("spawned", spark, _files(spark, d), detectors=10)
    return x.groupBy("det_id").agg(F.count(F.lit(1)).alias("n"), F.sum("psi").alias("psi_sum"))


PARENT = PIX.format(n=1, src=f"SELECT pix, acos(z) AS th, phi AS ph, x FROM ({CENTRE.format(n=2)}) q JOIN (SELECT range AS k, range % 11 AS x FROM range(48)) v ON v.k = q.pix")


@register("SRC-11", "pix", "value", "SELECT range//4 AS pix, avg((range*7 % 13)*1e-3) AS value FROM range(48) GROUP BY 1", 9)
def nested_map_file(spark, d):
    """A nested map in thousandths of its unit: four children of a coarse pixel follow each other."""
    path = shared_path(spark, "map")
    k = F.col("id")
    spark.range(48).select(k.alias("pix"), (k * 7 % 13 * 1.0).alias("value"), F.lit(2).alias("nside"), F.lit("NESTED").alias("ordering")).write.parquet(path)
    return mm.degrade(layouts.read_map(spark, path, 1e-3), 2, 1, "value").select("pix", "value")


@register("SRC-12", "pix", "value rms flat", """SELECT pix, s_q AS value, sqrt(pow(1e0 + pix % 5, 2) + pow(1e-1*(SELECT avg(abs(s_q)) FROM sky), 2)) AS rms, sqrt(4e0 + pow(1e-1*(SELECT avg(abs(s_q)) FROM sky), 2)) AS flat FROM sky""", 9)
def data_map_file(spark, d):
    path = shared_path(spark, "map")
    t.sky(spark).select("pix", F.col("s_q").alias("value")).write.parquet(path)
    signal = layouts.read_map(spark, path)
    rms = t.sky(spark).select("pix", (F.col("pix") % 5 + 1.0).alias("rms"))
    flat = layouts.data_map(signal, None, t.NPIX, 2.0, 0.1).select("pix", F.col("rms").alias("flat"))
    return layouts.data_map(signal, rms, t.NPIX, None, 0.1).join(flat, "pix")


@register("SRC-13 SRC-14 SNK-02 SRC-20", "comp l m", "re im", """SELECT c AS comp, a.l, a.m, CASE WHEN c = 'absent' OR a.vec_id IS NULL THEN 0e0 ELSE a.re END AS re, CASE WHEN c = 'absent' THEN 0e0 ELSE a.im END AS im
    FROM (SELECT * FROM alm WHERE vec_id = 3) a CROSS JOIN (SELECT unnest(['dust', 'absent']) AS c) q""", 6)
def chain_amplitudes(spark, d):
    """A chain of component amplitudes with its parameters: written twice, the last iteration read back; a component that it lacks is zero."""
    path = shared_path(spark, "chain")
    sinks.write_parameters(spark, path, {"lmax": 9, "component": "dust"}, 1)
    for k in (2, 3):
        rows = t.alm(spark, d).where(F.col("vec_id") == k).select(F.lit("dust").alias("comp"), "l", "m", "re", "im")
        sinks.write_chain(rows, f"{path}/comps", 1, k, ("comp",))
    run = sinks.read_parameters(spark, path)
    chain = sinks.read_chain(spark, f"{path}/comps", 1)
    found = [layouts.alms_of_component(chain, c, run["lmax"]).withColumn("comp", F.lit(c)) for c in (run["component"], "absent")]
    return found[0].unionByName(found[1])


@register("SRC-16", "source", "amp alpha", "SELECT CAST(source AS VARCHAR) AS source, amp, alpha FROM sources", 6)
def source_catalogue(spark, d):
    """A catalogue as text, its columns named by the last comment line."""
    path = shared_path(spark, "catalogue")
    s = t.sources(spark, d)
    rows = s.select(F.concat_ws("   ", F.col("source").cast("string"), F.col("amp").cast("string"), F.col("alpha").cast("string")).alias("value"))
    spark.createDataFrame([("# a catalogue",), ("# source amp alpha",)], "value string").unionByName(rows).coalesce(1).write.text(path)
    return readers.read_catalogue(spark, path)


@register("SRC-18", "det_id scan_id", "g_abs g_rel g_temp", """WITH g AS (SELECT det_id, scan_id, avg(tod)/1e1 AS g FROM samples WHERE band = 'A' GROUP BY 1, 2), h AS (SELECT *, avg(g) OVER () AS a, avg(g) OVER (PARTITION BY det_id) AS gd FROM g)
    SELECT det_id, scan_id, CASE WHEN scan_id % 2 = 0 THEN 2e0 ELSE a END AS g_abs, CASE WHEN scan_id % 2 = 0 THEN 5e-1 ELSE gd - a END AS g_rel, CASE WHEN scan_id % 2 = 0 THEN 25e-2 ELSE g - gd END AS g_temp FROM h""", 6)
def resumed_gains(spark, d):
    """Gains of a chain where it has the scan, else decomposed from the file's."""
    g = t.samples(spark, d).where("band = 'A'").groupBy("band", "det_id", "scan_id").agg((F.avg("tod") / 10.0).alias("g"))
    fresh = cal.decompose_gains(g, "det_id", "g").select(*gibbs.SCAN, "g_abs", "g_rel", "g_temp")
    chain = gibbs.Chain(spark, shared_path(spark, "chain"))
    old = g.where("scan_id % 2 = 0").select(*gibbs.SCAN, F.lit(2.0).alias("g_abs"), F.lit(0.5).alias("g_rel"), F.lit(0.25).alias("g_temp"))
    return gibbs.resumed(fresh, chain.keep("gains", old, 4))


N = 3
# offsets of later jumps count from the level that earlier ones have led to
JUMPS = f"""{ISLANDS}, v AS (SELECT *, row_number() OVER (PARTITION BY det_id, scan_day ORDER BY i) AS rank FROM k WHERE keep),
    g AS (SELECT det_id, scan_day, min(i) AS lo, max(i) + 1 AS hi FROM r WHERE NOT keep GROUP BY det_id, scan_day, run),
    w AS (SELECT g.det_id, g.scan_day, g.lo, g.hi, coalesce(max(CASE WHEN v.i < g.lo THEN v.rank END), 0) AS seen, coalesce(max(v.rank), 0) AS every FROM g
      LEFT JOIN v ON v.det_id = g.det_id AND v.scan_day = g.scan_day GROUP BY 1, 2, 3, 4),
    o AS (SELECT w.det_id, w.scan_day, w.hi, row_number() OVER (PARTITION BY w.det_id, w.scan_day ORDER BY w.hi) AS q, avg(CASE WHEN v.rank <= w.seen THEN v.tod END) - avg(CASE WHEN v.rank > w.seen THEN v.tod END) AS raw,
      list(v.i) FILTER (v.rank <= w.seen) AS before FROM w JOIN v ON v.det_id = w.det_id AND v.scan_day = w.scan_day AND v.rank BETWEEN w.seen - {N - 1} AND w.seen + {N}
      WHERE w.seen >= {N} AND w.every - w.seen >= {N} GROUP BY w.det_id, w.scan_day, w.hi),
    j AS (SELECT det_id, scan_day, CAST(0 AS BIGINT) AS q, CAST([] AS BIGINT[]) AS places, CAST([] AS DOUBLE[]) AS offs, CAST(0 AS BIGINT) AS hi, 0e0 AS off FROM (SELECT DISTINCT det_id, scan_day FROM o) s
      UNION ALL SELECT det_id, scan_day, q, list_append(places, hi), list_append(offs, off), hi, off FROM (
      SELECT j.det_id, j.scan_day, o.q, j.places, j.offs, o.hi, o.raw - coalesce(list_sum(j.offs), 0e0)
        + coalesce(list_sum(list_transform(range(1, len(j.offs) + 1), lambda x: j.offs[x]*len(list_filter(o.before, lambda y: y >= j.places[x])))), 0e0)/{N}e0 AS off
      FROM j JOIN o ON o.det_id = j.det_id AND o.scan_day = j.scan_day AND o.q = j.q + 1) n)"""
RECURSIVE = JUMPS.replace("WITH k AS", "WITH RECURSIVE k AS", 1)


def _jumps(spark, d):
    x = t.timeline(spark, d).withColumn("valid", F.col("flag").bitwiseAND(F.lit(2)) == 0)
    return x, tl.detect_jumps(x, KEYS, "tod", 2, N)


@register("WIN-04 WIN-05 SNK-05 SRC-19", "det_id scan_day i", "corrected", f"""{RECURSIVE} SELECT k.det_id, k.scan_day, k.i, k.tod + coalesce(sum(j.off), 0e0) AS corrected FROM k
    LEFT JOIN j ON j.q > 0 AND j.det_id = k.det_id AND j.scan_day = k.scan_day AND j.hi <= k.i GROUP BY k.det_id, k.scan_day, k.i, k.tod""", 6)
def jumps_detected_and_applied(spark, d):
    """Jumps from the levels on both sides of flagged runs; their catalogue is packed, written, read, unpacked and applied."""
    x, catalogue = _jumps(spark, d)
    path = shared_path(spark, "jumps")
    tl.pack_jumps(catalogue, KEYS).write.parquet(path)
    return tl.apply_jumps(x, tl.unpack_jumps(spark.read.parquet(path), KEYS), KEYS, "tod")


@register("AGG-24 WIN-04", "det_id scans jumps fewest most", "mean_n size", f"""{RECURSIVE}, c AS (SELECT det_id, scan_day, count(CASE WHEN q > 0 THEN 1 END) AS c FROM j GROUP BY 1, 2),
    a AS (SELECT det_id, scan_day, max(CASE WHEN NOT keep THEN 1 ELSE 0 END) AS marked FROM k GROUP BY 1, 2), e AS (SELECT a.det_id, a.scan_day, coalesce(c.c, 0) AS c FROM a LEFT JOIN c ON c.det_id = a.det_id AND c.scan_day = a.scan_day WHERE marked = 1),
    s AS (SELECT det_id, median(abs(off)) AS size FROM j WHERE q > 0 GROUP BY 1)
    SELECT e.det_id, count(*) AS scans, CAST(sum(e.c) AS BIGINT) AS jumps, min(e.c) AS fewest, max(e.c) AS most, avg(e.c) AS mean_n, any_value(s.size) AS size FROM e JOIN s ON s.det_id = e.det_id GROUP BY 1""", 6)
def jump_statistics(spark, d):
    _, found = _jumps(spark, d)
    n = F.size("jumps").cast("long")
    counts = found.groupBy("det_id").agg(F.count(F.lit(1)).alias("scans"), F.sum(n).alias("jumps"), F.min(n).alias("fewest"), F.max(n).alias("most"), F.avg(n).alias("mean_n"))
    size = found.select("det_id", F.explode("jumps").alias("j")).groupBy("det_id").agg(F.median(F.abs("j.offset")).alias("size"))
    return counts.join(size, "det_id")


GAIN = "(15e-1 + (det_id - 15e-1)*1e-2)"


@register("GAIN-02", "det_id scan_day i", "filled", f"SELECT det_id, scan_day, i, CASE WHEN (flag & 2) = 0 THEN tod ELSE {GAIN}*({SIGNAL}) + ((i*7 + det_id*13) % 11 - 5e0)/3e0*(1e0 + det_id)/2e0 END AS filled FROM timeline JOIN sky USING (pix)", 9)
def calibration_gaps_filled(spark, d):
    """Flagged samples become gain times sky and white noise of means over four samples, the draw supplied."""
    x = mm.with_sky(t.timeline(spark, d), t.sky(spark), t.NPIX).withColumn("keep", F.col("flag").bitwiseAND(F.lit(2)) == 0)
    gain, eta = (F.col("det_id") - 1.5) * 1e-2 + 1.5, ((F.col("i") * 7 + F.col("det_id") * 13) % 11 - 5.0) / 3.0
    return x.withColumn("filled", tl.calibration_gaps(x, "tod", "keep", F.col("signal"), gain, F.col("det_id") + 1.0, 4, eta))


# a delay of one sample on a mirrored scan, and its transpose
DELAY = lambda f: np.exp(-2j * np.pi * f)
TRANSPOSED = """coalesce(lead(u) OVER (PARTITION BY det_id, scan_day ORDER BY i), 0e0) + CASE WHEN i = 0 THEN u ELSE 0e0 END"""
ADJOINT = "SELECT pix, sum(v) AS s_i, sum(v*cos(2e0*psi)) AS s_q, sum(v*sin(2e0*psi)) AS s_u FROM (SELECT pix, psi, {v} AS v FROM ({{}}) a) b GROUP BY pix".format(v=TRANSPOSED)
NOISE = "SELECT *, (x - avg(x) OVER (PARTITION BY det_id, scan_day))/pow(1e0 + det_id, 2) AS u FROM ({}) y"


def _scan_model():
    return unbinned.ScanModel(1.0, unbinned.white_without_mean, DELAY)


def _unbinned(spark, d):
    return t.timeline(spark, d).withColumn("sigma0", F.col("det_id") + 1.0)


@register("CGM-02 CGM-04 CGM-10", "pix", "s_i s_q s_u", ADJOINT.format(NOISE.format("SELECT *, tod AS x FROM timeline")), 5)
def unbinned_right_side(spark, d):
    """P^T T^T N^-1 d with a delay as T and offsets of the scans projected out by N^-1."""
    return unbinned.right_side(_unbinned(spark, d), KEYS, _scan_model())


@register("CGM-01 CGM-02 CGM-09", "pix", "s_i s_q s_u", ADJOINT.format(NOISE.format(f"SELECT *, lag(s, 1, s) OVER (PARTITION BY det_id, scan_day ORDER BY i) AS x FROM (SELECT t.*, {SIGNAL} AS s FROM timeline t JOIN sky USING (pix)) z")), 5)
def unbinned_left_side(spark, d):
    """P^T T^T N^-1 T P of a sky, which no binned matrix gives."""
    return unbinned.left_side(_unbinned(spark, d), KEYS, _scan_model(), t.sky(spark), t.NPIX)


@register("CGM-05 CGM-06 CGM-11 CGM-13", "pix", "s_i s_q s_u", ADJOINT.format("SELECT *, tod/pow(1e0 + det_id, 2) AS u FROM timeline"), 1)
def unbinned_solution(spark, d):
    """The solution, put back into the operator, gives the right side."""
    unbinned_path = shared_path(spark, "timeline")
    _unbinned(spark, d).write.parquet(unbinned_path)  # each iteration reads the samples from their table
    x = spark.read.parquet(unbinned_path)
    model = unbinned.ScanModel(1.0, unbinned.white, DELAY)
    return unbinned.left_side(x, KEYS, model, unbinned.solve(x, KEYS, model, t.NPIX, 1e-6), t.NPIX)


STATS = """SELECT band, det_id, scan_id, avg(CASE WHEN flag = 0 THEN 1e0 ELSE 0e0 END) AS gf, count(CASE WHEN flag = 0 THEN 1 END) AS n,
    (sum(CASE WHEN flag = 0 THEN pow((tod - 35e0)/(sigma0*2e1), 2) END) - count(CASE WHEN flag = 0 THEN 1 END))/sqrt(2e0*count(CASE WHEN flag = 0 THEN 1 END)) AS z FROM samples GROUP BY 1, 2, 3"""


@register("SEL-02 SEL-01 FLT-03 SNK-09", "band pix hits", "s_i s_q s_u rms_i d_i n_i a_ii", f"""WITH st AS ({STATS}), g AS (SELECT x.*, pow((15e-1 + (x.det_id - 15e-1)*1e-2)/sigma0, 2) AS w, cos(2e0*psi) AS c, sin(2e0*psi) AS s, tod/(15e-1 + (x.det_id - 15e-1)*1e-2) AS d,
      (x.pix % 7)*1e-1 AS dip, (x.scan_id % 5)*1e-1 AS nc FROM samples x JOIN st ON x.band = st.band AND x.det_id = st.det_id AND x.scan_id = st.scan_id WHERE flag = 0 AND gf >= 82e-2 AND abs(z) <= 5e0),
    e AS (SELECT band, pix, sum(w) AS a_ii, sum(w*c) AS a_iq, sum(w*s) AS a_iu, sum(w*c*c) AS a_qq, sum(w*c*s) AS a_qu, sum(w*s*s) AS a_uu, sum(w*d) AS b_i, sum(w*d*c) AS b_q, sum(w*d*s) AS b_u,
      sum(w*dip) AS d0, sum(w*dip*c) AS d1, sum(w*dip*s) AS d2, sum(w*nc) AS n0, sum(w*nc*c) AS n1, sum(w*nc*s) AS n2, count(*) AS hits FROM g GROUP BY 1, 2),
    i AS (SELECT *, a_qq*a_uu - a_qu*a_qu AS c11, a_iu*a_qu - a_iq*a_uu AS c12, a_iq*a_qu - a_iu*a_qq AS c13, a_ii*a_uu - a_iu*a_iu AS c22, a_iq*a_iu - a_ii*a_qu AS c23, a_ii*a_qq - a_iq*a_iq AS c33 FROM e),
    f AS (SELECT *, a_ii*c11 + a_iq*c12 + a_iu*c13 AS det FROM i)
    SELECT band, pix, hits, (c11*b_i + c12*b_q + c13*b_u)/det AS s_i, (c12*b_i + c22*b_q + c23*b_u)/det AS s_q, (c13*b_i + c23*b_q + c33*b_u)/det AS s_u, sqrt(c11/det) AS rms_i,
    (c11*d0 + c12*d1 + c13*d2)/det AS d_i, (c11*n0 + c12*n1 + c13*n2)/det AS n_i, a_ii FROM f WHERE det > 1e-12*a_ii*a_qq*a_uu""", 4)
def fused_band_pass(spark, d):
    """Both vetoes, then signal, dipole and correlated-noise maps in one aggregation; written as diagnostics and read back."""
    x = t.samples(spark, d)
    stats = tl.chisq_z(x, gibbs.SCAN, F.col("tod") - 35.0, F.col("flag") == 0, F.col("sigma0") * 20.0)
    g = (F.col("det_id") - 1.5) * 1e-2 + 1.5
    streams = {"s": F.col("tod") / g, "d": F.col("pix") % 7 * 0.1, "n": F.col("scan_id") % 5 * 0.1}
    equations = mm.fused_equations(x.where("flag = 0"), cal.accepted(stats, gibbs.SCAN, 0.82, 5.0), gibbs.SCAN, ["band", "pix"], (g / F.col("sigma0")) * (g / F.col("sigma0")), streams)
    path = shared_path(spark, "diagnostics")
    schema = sinks.write_diagnostics(equations, mm.solve_fused(equations, ["band", "pix"], tuple(streams)), path)
    return spark.read.schema(schema).parquet(path).where("s_rms < double('infinity')").withColumnRenamed("s_rms", "rms_i")


@register("NOI-08 NOI-09 NOI-10 NOI-11", "det_id scan_day i", "value", """SELECT det_id, scan_day, i, CASE WHEN (flag & 2) = 0 THEN tod*9e0/(9e0 + pow(1e0 + det_id, 2)) ELSE 0e0 END AS value FROM timeline""", 6)
def constrained_noise_white_limit(spark, d):
    """The mean of noise with a flat spectrum, by conjugate gradients on the gaps alone: the samples' own share, and nothing in a gap."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, mask = pdf["tod"].to_numpy(float), ((pdf["flag"].to_numpy() & 2) == 0).astype(float)
        draw = noise.constrained_noise(x, mask, float(pdf["det_id"].iloc[0]) + 1.0, np.full(len(x) + 1, 1 / 9.0), tolerance=1e-12, most=500)
        return pdf[[*KEYS, "i"]].assign(value=draw.noise)

    return fourier.over_scans(t.timeline(spark, d), KEYS, run, "det_id long, scan_day long, i long, value double")


# spectra by the sum over samples itself
SPECTRUM = """WITH n AS (SELECT det_id, scan_day, count(*) AS n FROM timeline GROUP BY 1, 2), q AS (SELECT n.*, unnest(range(1, n//2 + 1)) AS h FROM n),
    f AS (SELECT q.det_id, q.scan_day, q.n, h, (pow(sum(tod*cos(2e0*pi()*h*i/q.n)), 2) + pow(sum(tod*sin(2e0*pi()*h*i/q.n)), 2))/q.n AS p FROM q JOIN timeline t ON t.det_id = q.det_id AND t.scan_day = q.scan_day GROUP BY 1, 2, 3, 4)"""


@register("WIN-12", "det_id scan_day bin", "f power", f"""{SPECTRUM} SELECT det_id, scan_day, CAST(least(11, floor(12e0*ln(h*1e0)/ln((n//2)*(1e0 + 1e-9)))) AS BIGINT) AS bin, avg(h*1e0/n) AS f, avg(p) AS power FROM f WHERE n > 4 GROUP BY 1, 2, 3""", 3)
def binned_spectra(spark, d):
    x = fourier.scan_spectra(t.timeline(spark, d), KEYS, "tod", 1.0, 12)
    long = t.timeline(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 4")
    return x.where("power is not null and not isnan(power)").join(long, KEYS, "left_semi")


@register("SIM-08 CGM-02", "det_id scan_day i", "tod", f"SELECT det_id, scan_day, i, 15e-1*lag(s, 1, s) OVER (PARTITION BY det_id, scan_day ORDER BY i) AS tod FROM (SELECT t.*, {SIGNAL} AS s FROM timeline t JOIN sky USING (pix)) z", 6)
def simulated_delay(spark, d):
    """A simulated scan without noise, its transfer function a delay of one sample."""
    x = mm.with_sky(t.timeline(spark, d), t.sky(spark), t.NPIX)
    return simulation.simulate(x, KEYS, "signal", 1, 1.0, 0.0, gain=1.5, response=DELAY)


@register("SIM-03", "sample", "psi", "SELECT event_id - 150 AS sample, psi FROM timeline WHERE event_id >= 150 AND event_id < 650", 9)
def stored_pointing(spark, d):
    return simulation.stored_pointing(t.timeline(spark, d).select(F.col("event_id").alias("sample"), "psi"), 100, 500, 50)


@register("SIM-16 SHT-12 SKY-14 SKY-16", "vec_id l m", "re im back", """SELECT vec_id, l, m, re*sqrt(1e0/(l*(l + 1e0))) AS re, im*sqrt(1e0/(l*(l + 1e0))) AS im, re AS back FROM alm WHERE l > 2""", 8)
def alms_of_a_spectrum(spark, d):
    """Unit draws times the root of a spectrum, the lowest degrees left out; the inverse root gives the draws back."""
    cl = spark.range(10).select(F.col("id").alias("l"), F.when(F.col("id") > 0, F.lit(1.0) / (F.col("id") * (F.col("id") + 1.0))).otherwise(0.0).alias("cl"))
    every = t.alm(spark, d)
    own = every.join(F.broadcast(cl), "l")  # ten rows
    drawn = comp.anisotropies(comp.prior_root(own, F.col("cl")))
    back = comp.prior_root(drawn, F.col("cl"), inverse=True).select("vec_id", "l", "m", F.col("re").alias("back"))
    return drawn.join(back, ["vec_id", "l", "m"])


@register("SHT-01 SHT-02 SHT-03 SHT-04 SHT-05 SRC-15", "vec_id l m", "re im", "SELECT vec_id, l, m, re, im FROM alm", 6)
def harmonic_round_trip(spark, d):
    """Every vector's coefficients to a map and back by least squares."""
    return _round_trip(spark, d, 9, 0)


@register("SHT-01 SHT-02 SHT-05", "vec_id l m", "re im", "SELECT vec_id, l, m, re, im FROM alm WHERE l >= 2", 6)
def harmonic_round_trip_spin2(spark, d):
    """The same as E, with a quarter of it turned by m as B, to Q and U and back."""
    return _round_trip(spark, d, 9, 2).where("l >= 2")


def _round_trip(spark, d, lmax, spin, nside=4):
    import pandas as pd

    order = harmonics.pairs(lmax)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(len(order), complex)
        for ell, m, re, im in zip(pdf["l"], pdf["m"], pdf["re"], pdf["im"], strict=True):
            a[harmonics.place(ell, m, lmax)] = re + 1j * im
        if spin:
            high = np.array([ell >= 2 for ell, _ in order])
            b = np.where(high, [0.25 * (-1) ** m for _, m in order], 0.0) * a
            back, _ = harmonics.least_squares_spin2(*harmonics.synthesis_spin2(np.where(high, a, 0), b, nside, lmax), nside, lmax)
        else:
            back = harmonics.least_squares(harmonics.synthesis(a, nside, lmax), nside, lmax)
        return pd.DataFrame([(int(pdf["vec_id"].iloc[0]), ell, m, back[k].real, back[k].imag) for k, (ell, m) in enumerate(order)], columns=["vec_id", "l", "m", "re", "im"])

    return t.alm(spark, d).groupBy("vec_id").applyInPandas(run, "vec_id long, l long, m long, re double, im double")


# harmonics up to l = 2 written out
Y = {(0, 0): "5e-1*sqrt(1e0/pi())", (1, 0): "sqrt(3e0/pi())/2e0*z", (1, 1): "-sqrt(3e0/(2e0*pi()))/2e0*r", (2, 0): "sqrt(5e0/pi())/4e0*(3e0*z*z - 1e0)", (2, 1): "-sqrt(15e0/(2e0*pi()))/2e0*z*r", (2, 2): "sqrt(15e0/(2e0*pi()))/4e0*r*r"}
WRITTEN = " + ".join(f"sum(CASE WHEN l = {ell} AND m = {m} THEN {'1e0' if m == 0 else '2e0'}*{y}*(re*cos({m}*phi) - im*sin({m}*phi)) ELSE 0e0 END)" for (ell, m), y in Y.items())


@register("SHT-01", "vec_id pix", "value", f"SELECT vec_id, pix, {WRITTEN} AS value FROM (SELECT *, sqrt((1e0 - z)*(1e0 + z)) AS r FROM ({CENTRE.format(n=2)}) c) p CROSS JOIN (SELECT * FROM alm WHERE l <= 2) a GROUP BY 1, 2", 6)
def harmonic_maps(spark, d):
    """Maps of degrees up to 2 by the two grouped stages, one group for each m and one for each ring."""
    a = t.alm(spark, d).select("vec_id", F.col("l").cast("int").alias("l"), F.col("m").cast("int").alias("m"), F.col("re").alias("a_re"), F.col("im").alias("a_im"))
    return harmonics.synthesis_table(a, ["vec_id"], t.NSIDE, 2)


@register("SHT-02 SHT-03 SHT-04", "vec_id l m", "re im", f"""WITH q AS (SELECT *, sqrt((1e0 - z)*(1e0 + z)) AS r FROM ({CENTRE.format(n=2)}) c), w AS (SELECT vec_id, k AS pix, v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS k FROM embeddings) WHERE k < 48),
    y AS ({" UNION ALL ".join(f"SELECT pix, {ell} AS l, {m} AS m, {y}*cos({m}*phi) AS c, {y}*sin({m}*phi) AS s FROM q" for (ell, m), y in Y.items())})
    SELECT vec_id, l, m, sum(v*c) AS re, -sum(v*s) AS im FROM w JOIN y USING (pix) GROUP BY 1, 2, 3""", 5)
def harmonic_adjoint(spark, d):
    """The adjoint of a map that each vector's first 48 numbers make (a map of nside 2 has 48 pixels)."""
    maps = t.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pix", "value")).where(F.col("pix") < t.NPIX)
    maps = maps.select("vec_id", F.col("pix").cast("long").alias("pix"), F.col("value").cast("double").alias("value"))
    return harmonics.adjoint_table(maps, ["vec_id"], t.NSIDE, 2).withColumnsRenamed({"a_re": "re", "a_im": "im"})


@register("SHT-17 SHT-18 SHT-19", "band pix", "value rms", "SELECT band, pix, value, 1e0/sqrt(25e-2) AS rms FROM (SELECT band, avg(tod) AS value FROM samples GROUP BY band) b CROSS JOIN pixels", 6)
def smoothed_maps(spark, d):
    """Noise-weighted smoothing leaves a flat map of even noise as it is."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pix")
        value, rms = harmonics.smooth(pdf["value"].to_numpy(), pdf["rms"].to_numpy(), t.NSIDE, 3, harmonics.gaussian_window(3, 600.0))
        return pdf[["band", "pix"]].assign(value=value, rms=rms)

    m = t.samples(spark, d).groupBy("band").agg(F.avg("tod").alias("value")).crossJoin(F.broadcast(spark.range(t.NPIX).toDF("pix"))).withColumn("rms", F.lit(2.0))
    return m.groupBy("band").applyInPandas(run, "band string, pix long, value double, rms double")


W = "1e0/(sigma0*sigma0)"
FIRST = f"""u AS (SELECT band, det_id, scan_id, sum(sg*w*tod) AS r, sum(sg*w*sg) AS d FROM (SELECT *, {SIGNAL} AS sg, {W} AS w FROM samples JOIN sky USING (pix) WHERE flag = 0) x GROUP BY 1, 2, 3),
    a AS (SELECT band, sum(r)/sum(d) AS g_abs FROM u GROUP BY 1), e AS (SELECT u.band, det_id, sum(r - g_abs*d) AS r, sum(d) AS d FROM u JOIN a ON a.band = u.band GROUP BY 1, 2),
    b AS (SELECT band, det_id, (r - sum(r/d) OVER (PARTITION BY band)/sum(1e0/d) OVER (PARTITION BY band))/d AS g_rel FROM e),
    g AS (SELECT u.band, u.det_id, u.scan_id, g_abs, g_rel, r/d - g_abs - g_rel AS g_temp FROM u JOIN a ON a.band = u.band JOIN b ON b.band = u.band AND b.det_id = u.det_id)"""


def _mixing(spark):
    return spark.createDataFrame([("A", 1.0, 1.0), ("N", 1.0, 0.3), ("R", 1.0, 0.1)], "band string, m0 double, m1 double")


def _chain(spark, d, iterations):
    chain = gibbs.Chain(spark, shared_path(spark, "gibbs"))
    gibbs.run(chain, t.samples(spark, d).where("flag = 0"), t.sky(spark), _mixing(spark), 2, t.NPIX, iterations)
    return chain


@register("ORC-02 GAIN-01 GAIN-04 GAIN-05 GAIN-06 SNK-03", "band det_id scan_id", "g_abs g_rel g_temp", f"WITH {FIRST} SELECT * FROM g", 6)
def gibbs_gains(spark, d):
    """Gains of the first iteration of a chain, as its sink keeps them."""
    return _chain(spark, d, 1).last("gains", 1)


@register("ORC-01 ORC-02 SEP-01 SNK-01 SNK-02", "pix solved", "c0 c1", f"""WITH {FIRST}, m AS (SELECT band, pix, {EQUATION_SUMS} FROM (SELECT x.band, x.pix, psi, pow((g_abs + g_rel + g_temp)/sigma0, 2) AS w, cos(2e0*psi) AS c, sin(2e0*psi) AS s, tod/(g_abs + g_rel + g_temp) AS d
      FROM samples x JOIN g ON g.band = x.band AND g.det_id = x.det_id AND g.scan_id = x.scan_id WHERE flag = 0) y GROUP BY band, pix), n AS (SELECT *, a_ii*(a_qq*a_uu - a_qu*a_qu) - a_iq*(a_iq*a_uu - a_qu*a_iu) + a_iu*(a_iq*a_qu - a_qq*a_iu) AS det FROM m),
    o AS (SELECT n.band, pix, ((a_qq*a_uu - a_qu*a_qu)*b_i + (a_iu*a_qu - a_iq*a_uu)*b_q + (a_iq*a_qu - a_iu*a_qq)*b_u)/det AS y, det/(a_qq*a_uu - a_qu*a_qu) AS w, m1 FROM n JOIN (VALUES ('A', 1e0), ('N', 3e-1), ('R', 1e-1)) v(band, m1) ON v.band = n.band WHERE det > 1e-12*a_ii*a_qq*a_uu),
    p AS (SELECT pix, sum(w) AS a, sum(w*m1) AS b, sum(w*m1*m1) AS c, sum(w*y) AS y0, sum(w*m1*y) AS y1 FROM o GROUP BY pix)
    SELECT pix, a*c - b*b > 1e-12*a*c AS solved, (c*y0 - b*y1)/(a*c - b*b) AS c0, (a*y1 - b*y0)/(a*c - b*b) AS c1 FROM p""", 4)
def gibbs_components(spark, d):
    """Components of the first iteration: calibrated band maps, solved pixel by pixel."""
    return _chain(spark, d, 1).last("components", 1)


@register("ORC-01", "band pix hits", "s_i rms_i")
def gibbs_second_iteration(spark, d):
    """Maps of the second iteration, whose sky is that of the first one's components."""
    return _chain(spark, d, 2).last("maps")


@register("SHT-23", "vec_id l m", "re im", "SELECT a.vec_id, a.l, a.m, a.re + 25e-2*b.re AS re, a.im + 25e-2*b.im AS im FROM alm a JOIN alm b ON b.vec_id = a.vec_id + 1 AND b.l = a.l AND b.m = a.m", 6)
def alm_scaled_sum(spark, d):
    a = t.alm(spark, d)
    return comp.scaled_sum(a, a.withColumn("vec_id", F.col("vec_id") - 1), 0.25, ["vec_id", "l", "m"])


VIEWS = "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'E' ELSE 'B' END AS pol, vec_id//3 AS comp, l, m, re, im FROM alm"


def _amplitudes(spark, d):
    pol = F.get(F.array(*map(F.lit, ("I", "E", "B"))), F.pmod("vec_id", F.lit(3)).cast("int"))
    return t.alm(spark, d).select(F.floor(F.col("vec_id") / 3).alias("comp"), pol.alias("pol"), "l", "m", "re", "im")


@register("SKY-19 SKY-20", "comp l m", "i_re e_re b_im", f"""WITH v AS ({VIEWS}) SELECT comp, l, m, max(CASE WHEN pol = 'I' THEN re END) AS i_re, max(CASE WHEN pol = 'E' THEN re END) AS e_re, max(CASE WHEN pol = 'B' THEN im END) AS b_im FROM v GROUP BY 1, 2, 3""", 6)
def joined_views(spark, d):
    return comp.joined(_amplitudes(spark, d))


@register("SKY-21 SKY-19", "comp pol l m", "re im", f"SELECT comp, pol, l, m, re, im FROM ({VIEWS}) v WHERE pol <> 'I'", 6)
def split_views(spark, d):
    """The polarised view of joined components."""
    return comp.split(comp.joined(_amplitudes(spark, d)), "QU")


@register("SKY-22", "comp pol l m", "re", f"SELECT comp, pol, l, m, CASE WHEN comp % 2 = 0 AND pol = 'I' THEN 2e0*re ELSE re END AS re FROM ({VIEWS}) v", 6)
def updated_views(spark, d):
    """Components take over what another list has of them; it must not have others."""
    own = _amplitudes(spark, d)
    other = own.where("comp % 2 = 0 and pol = 'I'").withColumns({"re": F.col("re") * 2.0})
    keys = ["comp", "pol", "l", "m"]
    if not comp.unmatched(own, other, keys).isEmpty():
        raise ValueError("an update of unknown components")
    return comp.updated(own, other, keys, ["re", "im"])


@register("SKY-23 SKY-25", "comp fault", "", """SELECT * FROM (VALUES ('b', 'a short name of another'), ('c', 'a short name of another'), ('d', 'several classes'), ('e', 'a view twice')) v(comp, fault)""")
def component_faults(spark, d):
    """Views of a list of components, and what is wrong with them."""
    rows = [("a", "Dust", "a", "IQU", True, 9), ("b", "Sync", "s", "I", True, 9), ("c", "Sync", "s", "QU", True, None), ("d", "Dust", "d", "I", True, 9), ("d", "Sync", "d", "QU", True, 9), ("e", "Cmb", "e", "IQU", True, 9), ("e", "Cmb", "e", "I", True, 9), ("f", "Cmb", "s", "I", False, 9)]
    return comp.faults(comp.views_of(spark.createDataFrame(rows, "comp string, class string, short string, pol string, enabled boolean, lmax int")))


MIXED = "SELECT *, pow(nu/1e2, -(comp % 4)*5e-1) AS factor, exp(-l*(l + 1e0)*fwhm*1e-3) AS beam FROM (SELECT * FROM ({v}) v WHERE pol = 'I') a CROSS JOIN bands"


def _mixed(spark, amplitudes):
    comps = amplitudes.select("comp").distinct().crossJoin(F.broadcast(t.bands(spark)))
    mixing = comps.select("comp", "band", "fwhm", F.pow(F.col("nu") / 100.0, (F.col("comp") % 4).cast("double") * -0.5).alias("factor"))
    return mixing, F.exp(F.col("l") * (F.col("l") + 1.0) * F.col("fwhm") * -1e-3)


@register("SKY-17", "band l m", "re im", f"SELECT band, l, m, sum(factor*beam*re) AS re, sum(factor*beam*im) AS im FROM ({MIXED.format(v=VIEWS)}) x GROUP BY 1, 2, 3", 5)
def components_in_bands(spark, d):
    a = _amplitudes(spark, d).where("pol = 'I'")
    return comp.to_bands(a, *_mixed(spark, a))


@register("SKY-18", "comp l m", "re im", f"""WITH x AS ({MIXED.format(v=VIEWS)}), y AS (SELECT band, l, m, sum(factor*beam*re) AS re, sum(factor*beam*im) AS im FROM x GROUP BY 1, 2, 3)
    SELECT comp, x.l, x.m, sum(factor*beam*y.re) AS re, sum(factor*beam*y.im) AS im FROM x JOIN y ON y.band = x.band AND y.l = x.l AND y.m = x.m GROUP BY 1, 2, 3""", 4)
def bands_to_components(spark, d):
    """The adjoint mixing of mixed bands; degrees that a component has not are not its own."""
    a = _amplitudes(spark, d).where("pol = 'I'")
    mixing, beam = _mixed(spark, a)
    back = comp.from_bands(comp.to_bands(a, mixing, beam), mixing, beam)
    return back.join(a.select("comp", "l", "m"), ["comp", "l", "m"], "left_semi")


@register("SKY-17 SEP-12", "band pix", "value", """WITH a AS (SELECT chan % 3 AS comp, pix, avg(d) AS v FROM channels GROUP BY 1, 2), f AS (SELECT *, pow(nu/1e2, -(5e-1 + (pix % 3)*1e-1)*comp) AS factor FROM a CROSS JOIN bands)
    SELECT band, pix, 1e2 - sum(CASE WHEN comp <> 1 THEN v*factor ELSE 0e0 END) AS value FROM f GROUP BY 1, 2""", 6)
def conditional_residual(spark, d):
    """Bands less the components held fixed, their mixing a function of the pixel."""
    a = t.channels(spark, d).groupBy((F.col("chan") % 3).alias("comp"), "pix").agg(F.avg("d").alias("value"))
    factor = a.select("comp", "pix").crossJoin(F.broadcast(t.bands(spark)))
    factor = factor.select("comp", "band", "pix", F.pow(F.col("nu") / 100.0, -(F.col("pix") % 3 * 0.1 + 0.5) * F.col("comp")).alias("factor"))
    sky = a.join(factor, ["comp", "pix"]).select("band", "comp", "pix", (F.col("value") * F.col("factor")).alias("value"))
    data = t.bands(spark).crossJoin(spark.range(t.NPIX).toDF("pix")).select("band", "pix", F.lit(100.0).alias("value"))
    return comp.residual(data, sky, [1])


@register("SKY-15 SKY-24", "pix", "value", "SELECT pix, s_i*1e3/(pow(x, 2)*exp(x)/pow(exp(x) - 1e0, 2)) AS value FROM sky CROSS JOIN (SELECT 1e9*(662607015e-42/1380649e-29)/27255e-4*1e2 AS x) q", 6)
def prior_mean_map(spark, d):
    """A map of an amplitude's prior mean, in thousandths of the thermodynamic unit of its reference frequency of 100 GHz."""
    from skyloom.functions import stokes

    path = shared_path(spark, "map")
    t.sky(spark).select("pix", F.col("s_i").alias("value")).write.parquet(path)
    return layouts.read_map(spark, path, 1e3).withColumn("value", F.col("value") / stokes.planck_ratio(F.lit(100.0)))


@register("FLT-08 FLT-10 FLT-12 SEP-13 SEP-14 SEP-15 GAIN-08 SIM-22", "name value", "", """SELECT * FROM (VALUES ('all components', 'cmb,dust'), ('some bands', 'A,R'), ('target', 'own'), ('unknown', 'group x: unknown components none'), ('view 0', 'A_I,R_QU'), ('view 1', 'A_QU'), ('transfer', 'single_pole')) v(name, value)""")
def run_parameters(spark, d):
    """What a run's parameters select, and the errors of those that name nothing."""
    groups = parameters.check_groups({"x": {"bands": ["A", "R"]}}, {"dust", "cmb"}, {"A", "N", "R"})
    try:
        parameters.check_groups({"x": {"components": ["none"]}}, {"dust"}, {"A"})
        error = ""
    except ValueError as e:
        error = str(e)
    parameters.check_tiers(groups, {"beta": {"resolve": ["x"]}})
    dealt = parameters.views({"A": "IQU", "R": "QU"}, 2)
    rows = [("all components", ",".join(groups["x"][0])), ("some bands", ",".join(groups["x"][1])), ("target", parameters.resolve("k", {"k": "own"}, {"k": "general"})), ("unknown", error)]
    rows += [(f"view {k}", ",".join(f"{b}_{v}" for b, v in part)) for k, part in enumerate(dealt)] + [("transfer", parameters.transfer_of({"tau": 1.0}, None)["kind"])]
    return spark.createDataFrame(rows, "name string, value string")


@register("FLT-11", "p keep", "", f"SELECT p, avg(CASE WHEN x > 4 THEN 1e0 ELSE 0e0 END) > 5e-1 AS keep FROM ({PARENT}) q GROUP BY p")
def coarse_mask(spark, d):
    """A mask at a coarser resolution keeps a pixel of which it keeps more than half."""
    k = F.col("id")
    m = spark.range(48).select(k.alias("pix"), (k % 11 > 4).alias("keep"))
    coarse = mm.threshold_mask(m, 2, 1).withColumnRenamed("pix", "p")
    if mm.keeps_all(coarse):
        raise ValueError("this mask keeps all")
    return coarse


@register("GEO-06", "id", "dec ra", """SELECT event_id AS id, asin(sin(lat)*sin(el) + cos(lat)*cos(el)*cos(az)) AS dec, sid - atan2(-cos(el)*sin(az), sin(el)*cos(lat) - cos(el)*sin(lat)*cos(az)) AS ra FROM (SELECT event_id, psi*2e0 AS az, 5e-1 + pix*1e-2 AS el, -4e-1 AS lat,
    (779057273264e-12 + ((event_id*60 + 17e8 - 946728000e0)/864e2)*100273781191135448e-17)*2e0*pi() - 118e-2 AS sid FROM timeline) q""", 5)
def horizon_pointing(spark, d):
    x = t.timeline(spark, d)
    dec, ra = geo.celestial(F.col("psi") * 2.0, F.col("pix") * 1e-2 + 0.5, -0.4, geo.sidereal_time(F.col("event_id") * 60 + 1.7e9, -1.18))
    return x.select(F.col("event_id").alias("id"), dec.alias("dec"), ra.alias("ra"))


THREE = """WITH s AS (SELECT pix, sum(w) AS a_ii, sum(w*m) AS a_iq, sum(w*n) AS a_iu, sum(w*m*m) AS a_qq, sum(w*m*n) AS a_qu, sum(w*n*n) AS a_uu, sum(w*d + sqrt(w)*e) AS b_i, sum(m*(w*d + sqrt(w)*e)) AS b_q, sum(n*(w*d + sqrt(w)*e)) AS b_u FROM
    (SELECT pix, d, 1e0/(rms*rms) AS w, pow(chan*1e0, -15e-1) AS m, chan*5e-1 AS n, ((pix*7 + chan*13) % 11 - 5e0)/3e0 AS e FROM channels WHERE pix <> 5) x GROUP BY pix),
    t AS (SELECT *, a_ii*(a_qq*a_uu - a_qu*a_qu) - a_iq*(a_iq*a_uu - a_qu*a_iu) + a_iu*(a_iq*a_qu - a_qq*a_iu) AS det FROM s)
    SELECT pix, ((a_qq*a_uu-a_qu*a_qu)*b_i + (a_iu*a_qu-a_iq*a_uu)*b_q + (a_iq*a_qu-a_iu*a_qq)*b_u)/det AS c0, ((a_iu*a_qu-a_iq*a_uu)*b_i + (a_ii*a_uu-a_iu*a_iu)*b_q + (a_iq*a_iu-a_ii*a_qu)*b_u)/det AS c1,
    ((a_iq*a_qu-a_iu*a_qq)*b_i + (a_iq*a_iu-a_ii*a_qu)*b_q + (a_ii*a_qq-a_iq*a_iq)*b_u)/det AS c2 FROM t"""


def _three(spark, d, method):
    from skyloom.operators import dense

    mixing = [F.lit(1.0), F.pow(F.col("chan").cast("double"), F.lit(-1.5)), F.col("chan") * 0.5]
    x = t.channels(spark, d).where("pix <> 5")  # a mask
    eta = ((F.col("pix") * 7 + F.col("chan") * 13) % 11 - 5.0) / 3.0
    return dense.solve_rows(mm.mixing_sums(x, "pix", mixing, F.col("d"), F.lit(1.0) / (F.col("rms") * F.col("rms")), eta), "pix", 3, method)


@register("LIN-10 LIN-09", "pix", "c0 c1 c2", THREE, 4)
def three_components(spark, d):
    """Three components a pixel with a supplied draw and a mask, by Cholesky factors."""
    return _three(spark, d, "cholesky")


@register("LIN-11 LIN-12", "pix", "c0 c1 c2", THREE, 4)
def three_components_by_lu(spark, d):
    return _three(spark, d, "lu")


@register("SNK-07", "line", "", """SELECT lpad(CAST(scan_day AS VARCHAR), 6, '0') || ' "scans/' || scan_day || '.parquet" 1 0.0 0.0' AS line FROM (SELECT DISTINCT scan_day FROM timeline)""")
def scan_manifest(spark, d):
    """The list of scan files as its sink writes it."""
    path = shared_path(spark, "manifest")
    scans = t.timeline(spark, d).select("scan_day").distinct()
    sinks.write_manifest(scans.select(F.lpad(F.col("scan_day").cast("string"), 6, "0").alias("pid"), F.concat(F.lit("scans/"), F.col("scan_day"), F.lit(".parquet")).alias("path")), path)
    return spark.read.text(path).toDF("line")


@register("SNK-04", "n", "total", "SELECT CAST(count(*) AS BIGINT) AS n, sum(tod) AS total FROM timeline WHERE det_id = 1", 6)
def ragged_export(spark, d):
    """A detector's scans as lengths and one array, the layout of exports."""
    scans = t.timeline(spark, d).where("det_id = 1").groupBy("scan_day").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "tod"))), lambda x: x["tod"]).alias("v"))
    flat = sinks.flat_form(scans, ["scan_day"], "v")
    return flat.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.aggregate("flat", F.lit(0.0), lambda a, x: a + x).alias("total"))
