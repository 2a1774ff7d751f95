"""Readers of scan tables by experiment, catalogues, and the canonical schemas.

Every reader gives one row a sample; ragged layouts are array columns that are exploded, and
coded columns are decoded by the given tree.  A reader is added by ``register_reader``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Reader = Callable[..., DataFrame]

SAMPLES = "band string, scan_id long, det_id long, i long, tod double, pix long, psi double, flag int"
SCANS = "band string, scan_id long, det_id long, fsamp double, vsun array<double>, tod array<float>, pix array<long>, psi array<float>, flag array<int>"
READERS: dict[str, Reader] = {}


def register_reader(name: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        READERS[name] = f
        return f

    return add


def read_samples(name: str, *args, **options) -> DataFrame:
    """Samples by a registered reader; an unknown name is an error that lists the known ones."""
    if name not in READERS:
        raise ValueError(f"no reader {name!r}; there are {', '.join(sorted(READERS))}")
    return READERS[name](*args, **options)


def explode_scans(scans: DataFrame) -> DataFrame:
    """Array-per-row scans as one row a sample."""
    z = F.arrays_zip("tod", "pix", "psi", "flag")
    out = scans.select("band", "scan_id", "det_id", F.posexplode(z).alias("i", "z"))
    return out.select("band", "scan_id", "det_id", F.col("i").cast("long").alias("i"), F.col("z.tod").cast("double").alias("tod"), "z.pix", F.col("z.psi").cast("double").alias("psi"), "z.flag")


@register_reader("scans")
def scans_with_cuts(
    spark: SparkSession, path: str, bits: int = 1, least_good: float = 0.75, largest_mean: float = 1e-3, largest_std: float = 1e-3, bad_scans: DataFrame | None = None
) -> DataFrame:
    """Detector-scans without those all zero, non-finite, too large, too often flagged or on a list."""
    s = spark.read.schema(SCANS).parquet(path)
    n = F.size("tod")
    total = F.aggregate("tod", F.lit(0.0), lambda a, x: a + F.abs(x))
    mean = F.aggregate("tod", F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate("tod", F.lit(0.0), lambda a, x: a + x * x) / n
    finite = F.forall("tod", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.size(F.filter("flag", lambda f: f.bitwiseAND(F.lit(bits)) == 0)) / n
    std = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    keep = (n > 0) & finite & (total > 0) & (total / n <= largest_mean) & (std <= largest_std) & (good >= least_good)
    out = s.where(keep)
    if bad_scans is not None:
        out = out.join(bad_scans.select("scan_id"), "scan_id", "left_anti")
    return explode_scans(out)


@register_reader("samples")
def plain_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).parquet(path)


@register_reader("intensity")
def intensity_only(spark: SparkSession, path: str) -> DataFrame:
    """Samples without a polarisation angle: psi is 0."""
    return spark.read.schema(SAMPLES).parquet(path).withColumn("psi", F.lit(0.0))


def reject_flagged_scans(samples: DataFrame, bits: int) -> DataFrame:
    """Drop every scan with any flagged sample."""
    bad = samples.where(F.col("flag").bitwiseAND(F.lit(bits)) != 0).select("band", "scan_id").distinct()
    return samples.join(bad, ["band", "scan_id"], "left_anti")


def spawn_detectors(samples: DataFrame, n: int) -> DataFrame:
    """One stored pointing for *n* detectors, their angles turned by eighths of a half turn."""
    dets = samples.sparkSession.range(n).toDF("spawned")
    return samples.crossJoin(F.broadcast(dets)).withColumn("psi", F.col("psi") + F.radians(F.col("spawned") % 8 * 22.5)).withColumn("det_id", F.col("spawned")).drop("spawned")


def scan_index(scans: DataFrame) -> DataFrame:
    """Compact index of the scans of each band, in order of scan_id."""
    return scans.withColumn("scan_index", (F.row_number().over(Window.partitionBy("band").orderBy("scan_id")) - 1).cast("long"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated catalogue whose last comment line names the columns; all are strings."""
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith("#")).withColumn("n", F.monotonically_increasing_id())
    head = heads.orderBy(F.col("n").desc()).first()
    if head is None:
        raise ValueError("the catalogue has no header line")
    names = head["value"].lstrip("# ").split()
    parts = F.split(F.trim("value"), r"\s+")
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return body.select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)))
