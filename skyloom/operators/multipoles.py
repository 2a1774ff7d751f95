"""Algebra on multipole coefficients in rows (l, m, re, im), m >= 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.mapmaking import small


def times(alm: DataFrame, fl: DataFrame, lmax: int = 1 << 14) -> DataFrame:
    """Multiply by a function of l (l, fl); rows of a missing l become 0."""
    f = F.coalesce("fl", F.lit(0.0))
    return alm.join(small(fl, lmax), "l", "left").withColumns({"re": F.col("re") * f, "im": F.col("im") * f}).drop("fl")


def project(alm: DataFrame, lmax: int) -> DataFrame:
    return alm.where(F.col("l") <= lmax)


def dot(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of a b* over all m, from the rows with m >= 0."""
    other = b.select(*keys, "l", "m", F.col("re").alias("re2"), F.col("im").alias("im2"))
    twice = F.when(F.col("m") == 0, 1.0).otherwise(2.0)
    product = F.col("re") * F.col("re2") + F.col("im") * F.col("im2")
    return a.join(other, [*keys, "l", "m"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(twice * product).alias("dot"))


def to_real(alm: DataFrame) -> DataFrame:
    """Real form (l, m of both signs, value), the norm kept: sqrt 2 on m != 0."""
    root = 2.0**0.5
    rows = F.when(F.col("m") == 0, F.array(F.struct(F.col("m").alias("m"), F.col("re").alias("value")))).otherwise(
        F.array(F.struct(F.col("m").alias("m"), (F.col("re") * root).alias("value")), F.struct((-F.col("m")).alias("m"), (F.col("im") * root).alias("value")))
    )
    return alm.withColumn("r", F.explode(rows)).select(*[c for c in alm.columns if c not in ("m", "re", "im")], "r.m", "r.value")


def to_complex(real: DataFrame) -> DataFrame:
    keys = [c for c in real.columns if c not in ("m", "value")]
    scale = F.when(F.col("m") == 0, 1.0).otherwise(2.0**-0.5)
    parts = real.withColumn("v", F.col("value") * scale)
    return parts.groupBy(*keys, F.abs("m").alias("m")).agg(
        F.sum(F.when(F.col("m") >= 0, F.col("v")).otherwise(0.0)).alias("re"), F.sum(F.when(F.col("m") < 0, F.col("v")).otherwise(0.0)).alias("im")
    )
