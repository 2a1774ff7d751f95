"""Domain views over the driver's tables: samples, timelines, sky maps, masks, gains, multipoles.

Each view exists as a DataFrame here and as SQL text in ``VIEWS``, for the oracle.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Resolution of the pixel column of the views.
NSIDE = 2
NPIX = 12 * NSIDE * NSIDE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered detector samples of three bands."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("band"),
        (F.col("l_suppkey") % 4).cast("long").alias("det_id"),
        F.year("l_shipdate").cast("long").alias("scan_id"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % NPIX).alias("pix"),
        (F.lit(pi) * (F.col("l_partkey") % 97) / 97.0).alias("psi"),
        (F.col("l_extendedprice") / 1e3).alias("tod"),
        F.when(F.col("l_discount") > 8e-2, 1).otherwise(0).alias("flag"),
        (F.lit(1.0) + F.col("l_suppkey") % 4).alias("sigma0"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered samples: one detector-scan for each detector and day."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("det_id"),
        F.unix_date(F.to_date("ts")).cast("long").alias("scan_day"),
        "event_id",
        F.col("value").alias("tod"),
        (F.col("event_id") % NPIX).alias("pix"),
        (F.lit(pi) * (F.col("event_id") % 97) / 97.0).alias("psi"),
        F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0).alias("flag"),
    )
    order = Window.partitionBy("det_id", "scan_day").orderBy("event_id")
    return events.withColumn("i", (F.row_number().over(order) - 1).cast("long"))


def sky(spark: SparkSession) -> DataFrame:
    p = F.col("id")
    return spark.range(NPIX).select(
        p.alias("pix"), (p % 7 + 10.0).alias("s_i"), (p % 5 - 2.0).alias("s_q"), (p % 3 - 1.0).alias("s_u")
    )


def mask(spark: SparkSession) -> DataFrame:
    return spark.range(NPIX).select(F.col("id").alias("pix"), (F.col("id") % 11 != 0).alias("keep"))


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", 30.0, 30.0), ("N", 100.0, 10.0), ("R", 353.0, 5.0)], "band string, nu double, fwhm double")


def gains(spark: SparkSession) -> DataFrame:
    d = F.col("id")
    return spark.range(4).select(d.alias("det_id"), F.lit(1.5).alias("g_abs"), ((d - 1.5) * 1e-2).alias("g_rel"))


def alm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipole coefficients up to l = 9 from the embedding vectors; m = 0 is real."""
    vectors = table(spark, sf_dir, "embeddings")
    at = vectors.select("vec_id", F.posexplode("embedding").alias("k", "v")).where("k < 55").select("vec_id", "k", F.col("v").cast("double").alias("v"))
    nxt = at.select((F.col("vec_id") - 1).alias("vec_id"), "k", F.col("v").alias("w"))
    ell = F.floor((F.sqrt(F.col("k") * 8.0 + 1.0) - 1.0) / 2.0)
    both = at.join(nxt, ["vec_id", "k"]).withColumn("l", ell).withColumn("m", F.col("k") - F.col("l") * (F.col("l") + 1) / 2)
    return both.select("vec_id", "l", F.col("m").cast("long").alias("m"), F.col("v").alias("re"), F.when(F.col("m") == 0, 0.0).otherwise(F.col("w")).alias("im"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five frequency channels of each pixel with values and rms."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % NPIX).alias("pix"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("chan"),
        (F.col("o_totalprice") / 1e4).alias("d"),
        (F.lit(1.0) + F.col("o_orderkey") % 3).alias("rms"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sources with amplitude, position and spectral index."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("source"),
        F.col("s_acctbal").alias("amp"),
        (k * 37 % 360 * (pi / 180)).alias("lon"),
        ((k * 23 % 160 - 80) * (pi / 180)).alias("lat"),
        (F.lit(-0.5) - (k % 5) * 1e-1).alias("alpha"),
    )


VIEWS = {
    "samples": """SELECT l_returnflag AS band, CAST(l_suppkey % 4 AS BIGINT) AS det_id,
        CAST(extract(year FROM l_shipdate) AS BIGINT) AS scan_id, (l_partkey*7 + l_linenumber) % 48 AS pix,
        pi()*(l_partkey % 97)/97e0 AS psi, l_extendedprice/1e3 AS tod,
        CASE WHEN l_discount > 8e-2 THEN 1 ELSE 0 END AS flag, 1e0 + (l_suppkey % 4) AS sigma0 FROM lineitem""",
    "timeline": """SELECT user_id % 4 AS det_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS scan_day, event_id, value AS tod, event_id % 48 AS pix,
        pi()*(event_id % 97)/97e0 AS psi, CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS flag,
        row_number() OVER (PARTITION BY user_id % 4, CAST(ts AS DATE) ORDER BY event_id) - 1 AS i FROM events""",
    "pixels": "SELECT range AS pix FROM range(48)",
    "sky": "SELECT range AS pix, 1e1 + range % 7 AS s_i, range % 5 - 2e0 AS s_q, range % 3 - 1e0 AS s_u FROM range(48)",
    "mask": "SELECT range AS pix, range % 11 <> 0 AS keep FROM range(48)",
    "bands": "SELECT * FROM (VALUES ('A', 3e1, 3e1), ('N', 1e2, 1e1), ('R', 353e0, 5e0)) v(band, nu, fwhm)",
    "gains": "SELECT range AS det_id, 15e-1 AS g_abs, (range - 15e-1)*1e-2 AS g_rel FROM range(4)",
    "alm": """SELECT a.vec_id, a.l, a.k - a.l*(a.l + 1)//2 AS m, a.v AS re,
        CASE WHEN a.k = a.l*(a.l + 1)//2 THEN 0e0 ELSE b.v END AS im
        FROM (SELECT *, CAST(floor((sqrt(8e0*k + 1e0) - 1e0)/2e0) AS BIGINT) AS l FROM flat) a
        JOIN flat b ON b.vec_id = a.vec_id + 1 AND b.k = a.k""",
    "flat": """SELECT vec_id, k, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v,
        unnest(range(0, len(embedding))) AS k FROM embeddings) WHERE k < 55""",
    "channels": """SELECT o_custkey % 48 AS pix, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS chan, o_totalprice/1e4 AS d,
        1e0 + o_orderkey % 3 AS rms FROM orders""",
    "sources": """SELECT s_suppkey AS source, s_acctbal AS amp, (s_suppkey*37 % 360)*(pi()/180) AS lon,
        (s_suppkey*23 % 160 - 80)*(pi()/180) AS lat, -5e-1 - (s_suppkey % 5)*1e-1 AS alpha FROM supplier""",
}


def with_views(sql: str) -> str:
    """*sql* behind a WITH clause of the views it names, in dependency order."""
    wanted = [v for v in ("flat", *(k for k in VIEWS if k != "flat")) if v in sql or v == "flat" and "alm" in sql]
    body = sql.strip()
    own = ""
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if body.upper().startswith("WITH "):
        own, body = body[15 if recursive else 5 :], ""
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    if not head:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {own}" if own else f"WITH {head} {body}"
