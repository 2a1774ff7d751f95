"""Queries: ordered timelines, geometry, codecs' arithmetic, streaming-like increments, relational forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import geometry as geo
from skyloom.functions import stokes
from skyloom.operators import timelines as tl
from skyloom.plans.registry import register
from skyloom.sources import driver_tables as t

KEYS = ["det_id", "scan_day"]
OVER = "OVER (PARTITION BY det_id, scan_day ORDER BY i)"


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return t.timeline(spark, d).withColumn("keep", F.col("flag").bitwiseAND(F.lit(2)) == 0)


@register("COD-01", "det_id scan_day i", "diff", f"SELECT det_id, scan_day, i, tod - coalesce(lag(tod) {OVER}, 0e0) AS diff FROM timeline")
def delta_encode(spark, d):
    return tl.difference(t.timeline(spark, d), KEYS, "tod")


@register("COD-02 GEO-05", "det_id scan_day i code diff", "angle", f"""WITH q AS (SELECT *, CAST(round_even(psi*4096e0/(2e0*pi()), 0) AS BIGINT) AS code FROM timeline)
    SELECT det_id, scan_day, i, code, code - coalesce(lag(code) {OVER}, 0) AS diff, 2e0*pi()*code/4096e0 AS angle FROM q""", 9)
def digitise_and_delta(spark, d):
    q = t.timeline(spark, d).withColumn("code", geo.bin_of_psi(F.col("psi"), 4096))
    return tl.difference(q, KEYS, "code").withColumn("angle", geo.psi_of_bin(F.col("code"), 4096))


@register("COD-08 COD-09", "det_id scan_day i code total", "", f"""WITH q AS (SELECT *, CAST(round_even(psi*4096e0/(2e0*pi()), 0) AS BIGINT) AS code FROM timeline)
    SELECT det_id, scan_day, i, code, code AS total FROM q""")
def delta_round_trip(spark, d):
    q = t.timeline(spark, d).withColumn("code", geo.bin_of_psi(F.col("psi"), 4096))
    return tl.cumulative(tl.difference(q, KEYS, "code"), KEYS, "diff")


@register("COD-10", "keep n", "", "SELECT (flag & 3) = 0 AS keep, count(*) AS n FROM timeline GROUP BY 1")
def good_data_mask(spark, d):
    return t.timeline(spark, d).groupBy((F.col("flag").bitwiseAND(F.lit(3)) == 0).alias("keep")).agg(F.count(F.lit(1)).alias("n"))


@register("WIN-01 WIN-02 WIN-03 FLT-01", "det_id scan_day block keep centre", "tod", """SELECT det_id, scan_day, i//8 AS block, bool_and((flag & 2) = 0) AS keep, (16*(i//8) + 7)//2 AS centre, avg(tod) AS tod
    FROM timeline GROUP BY 1, 2, 3 HAVING count(*) = 8""", 9)
def block_means(spark, d):
    return tl.blocks(_kept(spark, d), KEYS, 8, "tod", "keep")


@register("WIN-11", "det_id scan_day block", "tod", """WITH b AS (SELECT det_id, scan_day, i//8 AS block, avg(tod) AS tod FROM timeline GROUP BY 1, 2, 3 HAVING count(*) = 8)
    SELECT det_id, scan_day, block, tod FROM (SELECT *, max(block) OVER (PARTITION BY det_id, scan_day) AS m FROM b) x WHERE block < m""", 9)
def decimated_blocks(spark, d):
    return tl.blocks(_kept(spark, d), KEYS, 8, "tod", drop_last=True)


ISLANDS = f"""WITH k AS (SELECT *, (flag & 2) = 0 AS keep FROM timeline),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY det_id, scan_day, keep ORDER BY i) AS run FROM k)"""


@register("WIN-04", "det_id scan_day first last n", "", f"{ISLANDS} SELECT det_id, scan_day, min(i) AS first, max(i) AS last, count(*) AS n FROM r WHERE NOT keep GROUP BY det_id, scan_day, run")
def flagged_runs(spark, d):
    return tl.islands(_kept(spark, d), KEYS, "keep")


FILL = f"""{ISLANDS}, g AS (SELECT det_id, scan_day, min(i) AS lo, max(i) AS hi FROM r WHERE NOT keep GROUP BY det_id, scan_day, run),
    e AS (SELECT det_id, scan_day, max(i) AS top FROM timeline GROUP BY 1, 2),
    m AS (SELECT g.det_id, g.scan_day, g.lo, g.hi, any_value(e.top) AS top, avg(CASE WHEN k.i < g.lo THEN k.tod END) AS a, avg(CASE WHEN k.i > g.hi THEN k.tod END) AS b
      FROM g JOIN e ON e.det_id = g.det_id AND e.scan_day = g.scan_day
      LEFT JOIN k ON k.det_id = g.det_id AND k.scan_day = g.scan_day AND k.keep AND k.i BETWEEN g.lo - 21 AND g.hi + 21 GROUP BY 1, 2, 3, 4),
    f AS (SELECT det_id, scan_day, lo, hi, CASE WHEN lo > 0 THEN coalesce(a, 0e0) ELSE coalesce(b, 0e0) END AS a,
      CASE WHEN hi < top THEN coalesce(b, 0e0) ELSE coalesce(a, 0e0) END AS b FROM m)
    SELECT k.det_id, k.scan_day, k.i, CASE WHEN k.keep THEN k.tod ELSE f.a + (f.b - f.a)*(k.i - f.lo + 1)/(f.hi - f.lo + 2) END AS filled
    FROM k LEFT JOIN f ON f.det_id = k.det_id AND f.scan_day = k.scan_day AND k.i BETWEEN f.lo AND f.hi"""


@register("WIN-06 WIN-07", "det_id scan_day i", "filled", FILL, 9)
def filled_gaps(spark, d):
    return tl.fill_gaps(_kept(spark, d), KEYS, "tod", "keep")


@register("WIN-08", "det_id scan_day pairs", "sigma0", f"""WITH k AS (SELECT det_id, scan_day, CASE WHEN (flag & 2) = 0 AND (lag(flag) {OVER} & 2) = 0 THEN tod - lag(tod) {OVER} END AS x FROM timeline)
    SELECT det_id, scan_day, count(x) AS pairs, CASE WHEN count(x) >= 2 THEN stddev_samp(x)/sqrt(2e0) ELSE CAST('inf' AS DOUBLE) END AS sigma0 FROM k GROUP BY 1, 2""")
def sigma_simple(spark, d):
    return tl.sigma_simple(_kept(spark, d), KEYS, "tod", "keep")


CLIP = "SELECT det_id, r FROM (SELECT *, sqrt(sum(r*r) OVER (PARTITION BY det_id)/nullif(count(r) OVER (PARTITION BY det_id) - 1, 0)) AS s FROM {}) x WHERE abs(r) <= 5e0*s"


@register("WIN-09 WIN-10 NOI-12", "det_id pairs", "sigma0", f"""WITH p AS (SELECT det_id, sum(CASE WHEN i % 2 = 0 THEN tod ELSE -tod END)/sqrt(2e0) AS r FROM timeline GROUP BY det_id, scan_day, i//2 HAVING count(*) = 2 AND bool_and((flag & 2) = 0)),
    c1 AS ({CLIP.format("p")}), c2 AS ({CLIP.format("c1")}), c3 AS ({CLIP.format("c2")})
    SELECT det_id, count(*) AS pairs, CASE WHEN count(*) > 100 THEN sqrt(sum(r*r)/(count(*) - 1)) ELSE CAST('inf' AS DOUBLE) END AS sigma0 FROM c3 GROUP BY det_id""")
def sigma_robust(spark, d):
    return tl.sigma_robust(_kept(spark, d), ["det_id"], "tod", "keep", scan=("scan_day",))


@register("GEO-10", "det_id scan_day i", "bearing", f"""WITH a AS (SELECT *, acos(1e0 - 2e0*(pix + 5e-1)/48e0) AS th, psi*2e0 AS ph FROM timeline),
    b AS (SELECT *, lead(th) {OVER} AS t2, lead(ph) {OVER} AS p2 FROM a),
    c AS (SELECT *, atan2(sin(p2 - ph)*sin(t2), sin(th)*cos(t2) - cos(th)*sin(t2)*cos(p2 - ph)) AS x FROM b)
    SELECT det_id, scan_day, i, coalesce(x, lag(x) {OVER}) AS bearing FROM c""", 6)
def scan_bearing(spark, d):
    w = tl.ordered(KEYS)
    a = t.timeline(spark, d).withColumn("th", F.acos(F.lit(1.0) - (F.col("pix") + 0.5) * 2.0 / 48.0)).withColumn("ph", F.col("psi") * 2.0)
    x = a.withColumn("x", geo.bearing(F.col("th"), F.col("ph"), F.lead("th").over(w), F.lead("ph").over(w)))
    return x.withColumn("bearing", F.coalesce("x", F.lag("x").over(w)))


@register("WIN-18", "det_id scan_day i", "weighted", "SELECT det_id, scan_day, i, (tod - avg(tod) OVER (PARTITION BY det_id, scan_day))/4e0 AS weighted FROM timeline", 9)
def white_inverse_noise(spark, d):
    return t.timeline(spark, d).withColumn("weighted", (F.col("tod") - F.avg("tod").over(Window.partitionBy(*KEYS))) / 4.0)


ANG = "SELECT l_orderkey*100 + l_linenumber AS id, l_partkey, acos(1e0 - 2e0*((l_partkey*7919 % 10007) + 5e-1)/10007e0) AS th, (l_suppkey*104729 + l_partkey*31) % 9973*(2e0*pi()/9973e0) AS ph FROM lineitem"
PIX = """SELECT *, CASE WHEN za <= 2e0/3e0 THEN 2*n*(n - 1) + (n + jp - jm)*4*n + ((((jp + jm - n + 1 - ((n + 1 + jp - jm) % 2) + 1)//2) % (4*n)) + 4*n) % (4*n)
      WHEN z > 0e0 THEN 2*cr*(cr - 1) + CAST(floor(tt*cr) AS BIGINT) % (4*cr) ELSE 12*n*n - 2*cr*(cr + 1) + CAST(floor(tt*cr) AS BIGINT) % (4*cr) END AS p FROM (
    SELECT *, CAST(floor(n*(5e-1 + tt) - n*z*75e-2) AS BIGINT) AS jp, CAST(floor(n*(5e-1 + tt) + n*z*75e-2) AS BIGINT) AS jm,
      CAST(floor((tt - floor(tt))*reach) AS BIGINT) + CAST(floor((1e0 - tt + floor(tt))*reach) AS BIGINT) + 1 AS cr FROM (
    SELECT *, abs(z) AS za, n*CASE WHEN abs(z) < 99e-2 THEN sqrt(3e0*(1e0 - abs(z))) ELSE sin(th)/sqrt((1e0 + abs(z))/3e0) END AS reach FROM (
    SELECT *, cos(th) AS z, ph*2e0/pi() - 4e0*floor(ph*2e0/pi()/4e0) AS tt, {n} AS n FROM ({src}) s0) s1) s2) s3"""


@register("GEO-01 GEO-02 GEO-09", "p n", "th", f"SELECT p, count(*) AS n, avg(th) AS th FROM ({PIX.format(n=64, src=ANG)}) x GROUP BY p", 6)
def ang2pix_ring(spark, d):
    k = t.table(spark, d, "lineitem")
    th = F.acos(F.lit(1.0) - (F.col("l_partkey") * 7919 % 10007 + 0.5) * 2.0 / 10007.0)
    ph = (F.col("l_suppkey") * 104729 + F.col("l_partkey") * 31) % 9973 * (2.0 * 3.141592653589793 / 9973.0)
    return geo.with_pixel(k.select(th.alias("th"), ph.alias("ph")), 64, F.col("th"), F.col("ph"), "p").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.avg("th").alias("th"))


CENTRE = """SELECT p AS pix, CASE WHEN p < 2*n*(n-1) THEN 1e0 - nr*nr/(3e0*n*n) WHEN p < 12*n*n - 2*n*(n-1) THEN 2e0*(2*n - br)/(3e0*n) ELSE sr*sr/(3e0*n*n) - 1e0 END AS z,
    CASE WHEN p < 2*n*(n-1) THEN (p - 2*nr*(nr-1) + 5e-1)*pi()/2e0/nr WHEN p < 12*n*n - 2*n*(n-1) THEN ((p - 2*n*(n-1)) % (4*n) + CASE WHEN (br + n) % 2 = 0 THEN 5e-1 ELSE 0e0 END)*pi()/2e0/n
    ELSE (p - (12*n*n - 2*sr*(sr+1)) + 5e-1)*pi()/2e0/sr END AS phi FROM (SELECT range AS p, {n} AS n, CAST(floor((1e0 + sqrt(1e0 + 2e0*range))/2e0) AS BIGINT) AS nr,
    (range - 2*{n}*({n}-1))//(4*{n}) + {n} AS br, CAST(floor((1e0 + sqrt(2e0*(12*{n}*{n} - range) - 1e0))/2e0) AS BIGINT) AS sr FROM range(12*{n}*{n})) c"""


@register("GEO-04", "pix", "z phi", CENTRE.format(n=16), 9)
def pix2ang_ring(spark, d):
    return spark.range(12 * 16 * 16).select(F.col("id").alias("pix"), geo.pix2z(16, F.col("id")).alias("z"), geo.pix2phi(16, F.col("id")).alias("phi"))


@register("GEO-08", "pix children", "value rms", f"""SELECT p AS pix, count(*) AS children, avg(v) AS value, 1e0/sqrt(avg(1e0/(r*r))) AS rms FROM ({PIX.format(n=2, src=f"SELECT acos(z) AS th, phi AS ph, pix % 17*1e0 AS v, 1e0 + pix % 5 AS r FROM ({CENTRE.format(n=16).replace('AS z,', 'AS z,')}) q")}) x GROUP BY p""", 6)
def degraded_map(spark, d):
    from skyloom.operators import mapmaking as mm

    m = spark.range(12 * 16 * 16).select(F.col("id").alias("pix"), (F.col("id") % 17 * 1.0).alias("value"), (F.col("id") % 5 + 1.0).alias("rms"))
    return mm.degrade(m, 16, 2, "value").join(mm.degrade_rms(m, 16, 2, "rms"), "pix")


VEC = f"SELECT pix AS vp, sqrt((1e0 - z)*(1e0 + z))*cos(phi) AS x, sqrt((1e0 - z)*(1e0 + z))*sin(phi) AS y, z FROM ({CENTRE.format(n=2)}) v"
KX = "(1e9*(662607015e-42/1380649e-29)/27255e-4)"


@register("JOIN-05", "det_id n", "dipole top", f"""SELECT det_id, count(*) AS n, avg(o) AS dipole, max(o) AS top FROM (SELECT det_id, (x*3e4*cos(psi) + y*3e4*sin(psi) + z*1e3)*2725e3/299792458e0
    *pow({KX}*1e2, 2)*exp({KX}*1e2)/pow(exp({KX}*1e2) - 1e0, 2) AS o FROM timeline JOIN ({VEC}) v ON vp = pix) q GROUP BY det_id""", 6)
def orbital_dipole(spark, d):
    v = (F.cos("psi") * 3e4, F.sin("psi") * 3e4, F.lit(1e3))
    x = t.timeline(spark, d).withColumn("o", stokes.orbital_dipole(t.NSIDE, F.col("pix"), v, F.lit(100.0)))
    return x.groupBy("det_id").agg(F.count(F.lit(1)).alias("n"), F.avg("o").alias("dipole"), F.max("o").alias("top"))


@register("SIM-14 SIM-20", "pix", "t", f"""SELECT vp AS pix, 272548e-5*1e6*(1e0/((1e0/sqrt(1e0 - (9e8 + 1e8)/299792458e0/299792458e0))*(1e0 - (x*3e4 + z*1e4)/299792458e0)) - 1e0) AS t FROM ({VEC}) v""", 5)
def relativistic_dipole(spark, d):
    v = (F.lit(3e4), F.lit(0.0), F.lit(1e4))
    return spark.range(t.NPIX).select(F.col("id").alias("pix"), (stokes.relativistic_dipole(t.NSIDE, F.col("id"), v) * 1e6).alias("t"))


@register("GEO-07 SRC-04", "det n", "theta phi psi", """WITH q AS (SELECT det, b.event_id, cos((psi + 1e-1)/2e0)*cos(th/2e0) AS w0, th, psi AS ph, det*1e-2 AS xi FROM
    (SELECT event_id, psi, acos(1e0 - 2e0*(pix + 5e-1)/48e0) AS th FROM timeline) b CROSS JOIN (SELECT range AS det FROM range(3)) d)
    SELECT det, count(*) AS n, avg(acos(cos(th)*cos(xi) - sin(th)*sin(xi))) AS theta, avg(CASE WHEN th + xi > pi() THEN CASE WHEN ph > 0e0 THEN ph - pi() ELSE ph + pi() END ELSE ph END) AS phi, avg(CASE WHEN th + xi > pi() THEN 1e0 ELSE 0e0 END) AS psi FROM q GROUP BY det""", 6)
def detector_pointing(spark, d):
    dets = spark.range(3).select(F.col("id").alias("det"), (F.col("id") * 1e-2).alias("xi"))
    b = t.timeline(spark, d).select("psi", F.acos(F.lit(1.0) - (F.col("pix") + 0.5) * 2.0 / 48.0).alias("th"))
    both = b.crossJoin(F.broadcast(dets))
    q = geo.quaternion_product(geo.quaternion_product(geo.rotation_z(F.col("psi")), geo.rotation_y(F.col("th"))), geo.rotation_y(F.col("xi")))
    theta, phi, psi = geo.quaternion_angles(q)
    out = both.select("det", theta.alias("theta"), phi.alias("phi"), (F.round(F.abs(psi) / 3.141592653589793)).alias("psi"))
    return out.groupBy("det").agg(F.count(F.lit(1)).alias("n"), F.avg("theta").alias("theta"), F.avg("phi").alias("phi"), F.avg("psi").alias("psi"))


@register("AGG-22 AGG-23", "det_id n first_code", "total", """SELECT det_id, count(*) AS n, CAST(arg_min(pix, event_id) AS BIGINT) AS first_code, sum(tod) AS total FROM timeline GROUP BY det_id""")
def gathered_timelines(spark, d):
    scans = t.timeline(spark, d).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("event_id", "pix", "tod"))).alias("rows"))
    per_det = scans.groupBy("det_id").agg(F.sum(F.size("rows")).alias("n"), F.min(F.element_at("rows", 1)).alias("head"), F.sum(F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["tod"])).alias("total"))
    return per_det.select("det_id", "n", F.col("head.pix").alias("first_code"), "total")


@register("ORC-06", "path a b kind", "", """SELECT coalesce(x.o_orderkey, y.o_orderkey) AS path, x.v AS a, y.v AS b, CASE WHEN y.v IS NULL THEN 'removed' WHEN x.v IS NULL THEN 'added' ELSE 'changed' END AS kind
    FROM (SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0) x FULL JOIN
    (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 4 <> 0) y ON x.o_orderkey = y.o_orderkey WHERE x.v IS DISTINCT FROM y.v""")
def parameter_diff(spark, d):
    o = t.table(spark, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("a"))
    b = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderpriority")).alias("b"))
    both = a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.withColumn("kind", F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("changed"))


@register("ORC-08", "det_id scan_day", "value", "SELECT det_id, scan_day, arg_min(tod, i) AS value FROM timeline GROUP BY 1, 2")
def first_of_series(spark, d):
    return t.timeline(spark, d).groupBy(*KEYS).agg(F.min_by("tod", "i").alias("value"))
