"""Scan files in the layouts of the experiments: a row a detector-scan, streams coded.

A scan's pointing and flags are first differences coded with the scan's own Huffman tree, as is
the timeline of the ground layout; angles are bins of a turn.  ``write_scans`` makes such tables
from samples, and a reader of ``readers.READERS`` gives samples back, with the cuts of its
experiment.  Decoding is an Arrow-batched function of one row; rows never meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import codec
from skyloom.sources.readers import register_reader, reject_flagged_scans, spawn_detectors

CODED = (
    "band string, scan_id long, det_id long, nside int, npsi int, fsamp double, ntod long, vsun array<double>, hufftree array<long>, huffsymb array<long>, "
    "tod array<float>, ztod binary, zsymb array<long>, ztree array<long>, pix binary, psi binary, flag binary, scalars array<double>"
)
#: Bits of a flag that make a sample unusable in the satellite layout. Fixed value.
SATELLITE_FLAGS = 6111232


def write_scans(samples: DataFrame, path: str, nside: int, npsi: int, fsamp: float, fknee: float = 0.1, alpha: float = -1.0, coded_tod: bool = False) -> None:
    """Write samples (band, scan_id, det_id, i, tod, pix, psi, flag; gain and sigma0 constant a scan) as coded
    detector-scans, one directory a band.

    With *coded_tod* the timeline is rounded to integers and coded with a tree of its own.
    """

    def delta(x: np.ndarray) -> np.ndarray:
        return np.diff(x, prepend=0)

    def tree(*streams: np.ndarray) -> codec.Tree:
        return codec.build_tree(zip(*(v.tolist() for v in np.unique(np.concatenate(streams), return_counts=True)), strict=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        bins = np.round(np.mod(pdf["psi"].to_numpy(float), 2 * np.pi) * npsi / (2 * np.pi)).astype(np.int64)
        streams = [delta(pdf["pix"].to_numpy(np.int64)), delta(bins), delta(pdf["flag"].to_numpy(np.int64))]
        own = tree(*streams)
        pix, psi, flag = (codec.encode(s, own.codes()) for s in streams)
        row = {k: pdf[k].iloc[0] for k in ("band", "scan_id", "det_id")} | {"nside": nside, "npsi": npsi, "fsamp": fsamp, "ntod": len(pdf), "vsun": [1.0, 0.0, 0.0]}
        row |= {"hufftree": own.nodes.tolist(), "huffsymb": own.symbols.tolist(), "tod": None, "ztod": None, "zsymb": None, "ztree": None}
        if coded_tod:
            steps = delta(np.round(pdf["tod"].to_numpy(float)).astype(np.int64))
            z = tree(steps)
            row |= {"ztod": codec.encode(steps, z.codes()), "zsymb": z.symbols.tolist(), "ztree": z.nodes.tolist()}
        else:
            row["tod"] = pdf["tod"].to_numpy(np.float32).tolist()
        return pd.DataFrame([row | {"pix": pix, "psi": psi, "flag": flag, "scalars": [float(pdf["gain"].iloc[0]), float(pdf["sigma0"].iloc[0]), fknee, alpha]}])

    few = samples.select("band", "scan_id", "det_id", "i", "tod", "pix", "psi", "flag", "gain", "sigma0")
    few.groupBy("band", "scan_id", "det_id").applyInPandas(run, CODED).write.mode("overwrite").partitionBy("band").parquet(path)


def _decoded(data: Column, tree: Column, symbols: Column, n: Column) -> Column:
    """A coded stream's values: the running sums of its differences."""

    @F.pandas_udf("array<long>")
    def run(data: pd.Series, tree: pd.Series, symbols: pd.Series, n: pd.Series) -> pd.Series:
        rows = zip(data, tree, symbols, n, strict=True)
        return pd.Series([None if x is None else np.cumsum(codec.decode(bytes(x), codec.Tree(np.asarray(s, np.int64), np.asarray(t, np.int64)), int(k))) for x, t, s, k in rows], dtype=object)

    return run(data, tree, symbols, n)


def decoded_scans(spark: SparkSession, path: str, fourier_lengths: DataFrame | None = None) -> DataFrame:
    """Detector-scans with plain arrays tod, pix, psi, flag.  *fourier_lengths* (ntod, good) cuts a scan to
    a length whose transform is fast."""
    s = spark.read.schema(CODED).parquet(path)
    n = F.col("ntod")
    s = s.withColumns({c: _decoded(F.col(c), F.col("hufftree"), F.col("huffsymb"), n) for c in ("pix", "psi", "flag")})
    tod = F.coalesce(F.col("tod"), _decoded(F.col("ztod"), F.col("ztree"), F.col("zsymb"), n).cast("array<float>"))
    s = s.withColumn("tod", tod).withColumn("psi", F.transform("psi", lambda b: b * (2.0 * np.pi) / F.col("npsi"))).drop("ztod", "zsymb", "ztree", "hufftree", "huffsymb")
    if fourier_lengths is not None:
        s = s.join(fourier_lengths, "ntod", "left").withColumn("ntod", F.coalesce("good", "ntod")).drop("good")
        s = s.withColumns({c: F.slice(c, 1, F.col("ntod").cast("int")) for c in ("tod", "pix", "psi", "flag")})
    return s


def live(bits: int, least_good: float, largest_mean: float | None = None, largest_std: float | None = None) -> Column:
    """Whether a detector-scan is neither all zero nor too large, too often flagged or not finite."""
    n = F.size("tod")
    x = F.transform("tod", lambda v: v.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    # the mean stands in the first state, since a lambda evaluates what it holds again for each sample
    start = F.struct(mean.alias("mean"), F.lit(0.0).alias("sum"))
    squares = F.aggregate(x, start, lambda a, v: F.struct(a["mean"].alias("mean"), (a["sum"] + (v - a["mean"]) * (v - a["mean"])).alias("sum")), lambda a: a["sum"])
    spread = F.sqrt(F.greatest(squares / n, F.lit(0.0)))
    good = F.size(F.filter("flag", lambda f: f.bitwiseAND(F.lit(bits)) == 0)) / n
    keep = (n > 0) & F.forall("tod", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) & (total > 0) & (good >= least_good)
    if largest_mean is not None:
        keep &= total / n <= largest_mean
    return keep if largest_std is None else keep & (spread <= largest_std)


def samples_of(scans: DataFrame) -> DataFrame:
    """One row a sample, with the scan's gain as ``gain`` and its noise level as ``sigma0``."""
    z = F.arrays_zip("tod", "pix", "psi", "flag")
    out = scans.select("band", "scan_id", "det_id", F.get("scalars", F.lit(0)).alias("gain"), F.get("scalars", F.lit(1)).alias("sigma0"), F.posexplode(z).alias("i", "z"))
    return out.select("band", "scan_id", "det_id", F.col("i").cast("long").alias("i"), F.col("z.tod").cast("double").alias("tod"), "z.pix", "z.psi", F.col("z.flag").cast("int").alias("flag"), "gain", "sigma0")


@register_reader("satellite")
def satellite(spark: SparkSession, path: str, bits: int = SATELLITE_FLAGS, largest: float = 1e-3, bad_scans: DataFrame | None = None, fourier_lengths: DataFrame | None = None) -> DataFrame:
    """Float timelines, coded pointing; gains in millionths; scans on a list are left out."""
    s = decoded_scans(spark, path, fourier_lengths).where(live(bits, 0.75, largest, largest))
    if bad_scans is not None:
        s = s.join(bad_scans.select("scan_id"), "scan_id", "left_anti")
    return samples_of(s).withColumn("gain", F.col("gain") * 1e-6)


@register_reader("ground")
def ground(spark: SparkSession, path: str, bits: int = 1, first: int | None = None, last: int | None = None) -> DataFrame:
    """Timelines that may be coded too; no scans of a gain above 100; the range of scans includes its last one."""
    s = decoded_scans(spark, path).where((F.get("scalars", F.lit(0)) <= 100.0) & live(bits, 0.9))
    if first is not None:
        s = s.where(F.col("scan_id") >= first)
    return samples_of(s if last is None else s.where(F.col("scan_id") <= last))


@register_reader("infrared")
def infrared(spark: SparkSession, path: str, bits: int = 1) -> DataFrame:
    """Intensity only: angles are 0."""
    return samples_of(decoded_scans(spark, path).where(live(bits, 0.5))).withColumn("psi", F.lit(0.0))


@register_reader("simulated_satellite")
def simulated_satellite(spark: SparkSession, path: str, bits: int = 1) -> DataFrame:
    """A flagged sample of any detector rejects the whole scan."""
    return reject_flagged_scans(samples_of(decoded_scans(spark, path)), bits)


@register_reader("spawned")
def spawned(spark: SparkSession, path: str, detectors: int) -> DataFrame:
    """One stored pointing for many detectors."""
    return spawn_detectors(samples_of(decoded_scans(spark, path)), detectors)


def read_map(spark: SparkSession, path: str, factor: float = 1.0, column: str = "value", nside: int | None = None, nested: bool | None = None) -> DataFrame:
    """A map table (pix, value and, where known, nside and ordering) in the unit that *factor* leads to, in RING order.

    Parameters win over what the table says of itself; an ordering that neither names is RING.
    """
    m = spark.read.parquet(path)
    if nested is None:
        nested = "ordering" in m.columns and str(m.select("ordering").first()[0]).upper().startswith("NEST")
    if nested:
        if nside is None:
            nside = int(m.select("nside").first()[0])
        m = m.withColumn("pix", nested_to_ring(nside, F.col("pix")))
    return m.select("pix", (F.col(column) * factor).alias(column))


def nested_to_ring(nside: int, pix: Column) -> Column:
    """RING index of a NESTED one (nside a power of two): the bits of x and y of the pixel in its face,
    then the ring and the place along it."""
    order = int(nside).bit_length() - 1
    face = F.shiftright(pix, 2 * order)
    bit = lambda k: F.shiftright(pix, k).bitwiseAND(F.lit(1))
    x = sum((bit(2 * k) * (1 << k) for k in range(order)), F.lit(0).cast("long"))
    y = sum((bit(2 * k + 1) * (1 << k) for k in range(order)), F.lit(0).cast("long"))
    # a face's corner ring and quarter: three rows of four faces, the middle one turned by half a face
    row = F.floor(face / 4)
    ring = (row + 2) * nside - x - y - 1
    turn = F.when(row == 1, (face % 4) * 2).otherwise((face % 4) * 2 + 1)
    width = F.when(ring < nside, ring).when(ring > 3 * nside, F.lit(4 * nside) - ring).otherwise(F.lit(nside))
    shift = F.when((ring < nside) | (ring > 3 * nside), F.lit(0)).otherwise((ring - nside) % 2)
    before = F.when(ring < nside, ring * 2 * (ring - 1)).when(ring > 3 * nside, F.lit(12 * nside * nside) - width * 2 * (width + 1)).otherwise(F.lit(2 * nside * (nside - 1)) + (ring - nside) * (4 * nside))
    along = (turn * width + x - y + 1 + shift) / 2 - 1
    return (before + F.pmod(F.floor(along), width * 4)).cast("long")


def data_map(signal: DataFrame, rms: DataFrame | None, npix: int, uniform: float | None = None, fraction: float = 0.0) -> DataFrame:
    """pix, value, rms: a uniform rms where one is given; a *fraction* of the mean size of the signal is added in quadrature."""
    both = signal.withColumn("rms", F.lit(uniform)) if uniform is not None else signal.join(rms, "pix")
    if not fraction:
        return both.select("pix", "value", "rms")
    size = signal.agg((F.avg(F.abs("value")) * fraction).alias("more"))  # one row
    return both.crossJoin(F.broadcast(size)).select("pix", "value", F.sqrt(F.col("rms") * F.col("rms") + F.col("more") * F.col("more")).alias("rms"))


def alms_of_component(chain: DataFrame, component: str, lmax: int) -> DataFrame:
    """l, m, re, im of a component of a chain for all l up to *lmax*; those the chain lacks are 0."""
    spark = chain.sparkSession
    every = spark.range(lmax + 1).select(F.col("id").alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("m"))
    own = chain.where(F.col("comp") == component).select("l", "m", "re", "im")
    return every.join(own, ["l", "m"], "left").fillna(0.0, ["re", "im"])
