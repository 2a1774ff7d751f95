"""Ordered-timeline operators: differences, blocks, gaps, jumps, noise levels.

A timeline is keyed by its detector-scan and ordered by ``i``; windows are partitioned by
that key, so a task holds one scan at a time, never a detector's whole history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: str = "i"):
    return Window.partitionBy(*keys).orderBy(order)


def difference(df: DataFrame, keys: list[str], value: str, out: str = "diff") -> DataFrame:
    """First differences; the first element stays as it is."""
    return df.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(ordered(keys)), F.lit(0)))


def cumulative(df: DataFrame, keys: list[str], value: str, out: str = "total") -> DataFrame:
    """Inverse of ``difference``."""
    return df.withColumn(out, F.sum(value).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0)))


def blocks(df: DataFrame, keys: list[str], factor: int, value: str, keep: str | None = None, drop_last: bool = False) -> DataFrame:
    """Means of whole blocks of *factor* samples, AND of *keep*, and the centre sample.

    A trailing partial block is dropped; *drop_last* drops the last whole block as well.
    """
    aggs = [F.avg(value).alias(value), F.count(F.lit(1)).alias("n")]
    if keep:
        aggs.append(F.bool_and(keep).alias(keep))
    out = df.groupBy(*keys, F.floor(F.col("i") / factor).alias("block")).agg(*aggs).where(F.col("n") == factor).drop("n")
    if drop_last:
        out = out.withColumn("last", F.max("block").over(Window.partitionBy(*keys))).where("block < last").drop("last")
    return out.withColumn("centre", F.floor((F.col("block") * factor * 2 + factor - 1) / 2))


def islands(df: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Runs of samples that are not kept: first, last and length of each gap."""
    run = F.col("i") - F.row_number().over(ordered([*keys, keep]))
    return df.withColumn("run", run).where(~F.col(keep)).groupBy(*keys, "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def fill_gaps(df: DataFrame, keys: list[str], value: str, keep: str, reach: int = 21, eta: Column | None = None) -> DataFrame:
    """Gaps become lines between the means of the valid samples within *reach* positions on
    either side; at an edge the line is flat, with no valid sample on either side it is 0.
    *eta* adds a supplied draw."""
    w = ordered(keys)
    valid = F.when(F.col(keep), F.col(value))
    before = F.avg(valid).over(w.rowsBetween(-reach, -1))
    after = F.avg(valid).over(w.rowsBetween(1, reach))
    starts = F.col(keep).eqNullSafe(False) & F.coalesce(F.lag(keep).over(w), F.lit(True))
    ends = F.col(keep).eqNullSafe(False) & F.coalesce(F.lead(keep).over(w), F.lit(True))
    out = (
        df.withColumn("_left", F.when(starts, F.struct(F.col("i").alias("i"), before.alias("v"), F.lag(keep).over(w).isNotNull().alias("inside"))))
        .withColumn("_right", F.when(ends, F.struct(F.col("i").alias("i"), after.alias("v"), F.lead(keep).over(w).isNotNull().alias("inside"))))
        .withColumn("_left", F.last("_left", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # a running last from the other end; a frame that ends at the end of the scan is read anew for each row
        .withColumn("_right", F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    )
    zero = F.lit(0.0)
    left = F.when(F.col("_left.inside"), F.coalesce("_left.v", zero)).otherwise(F.coalesce("_right.v", zero))
    right = F.when(F.col("_right.inside"), F.coalesce("_right.v", zero)).otherwise(F.coalesce("_left.v", zero))
    share = (F.col("i") - F.col("_left.i") + 1) / (F.col("_right.i") - F.col("_left.i") + 2)
    line = left + (right - left) * share
    line = line if eta is None else line + eta
    return out.withColumn("filled", F.when(F.col(keep), F.col(value)).otherwise(line)).drop("_left", "_right")


def apply_jumps(df: DataFrame, jumps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add to each sample the offsets of all jumps at or before it; *jumps* has keys, loc, offset.

    Jumps stand among the samples as rows of their own, dealt by the scan alone, and samples that
    already are so stay; a join by place would deal all samples by place and then back by scan.
    """
    rows = jumps.dropna(subset=[*keys, "loc"]).select(*keys, F.col("loc").alias("i"), F.col("offset").alias("_offset"), F.lit(False).alias("_sample")).repartition(*keys)
    both = df.withColumns({"_offset": F.lit(0.0), "_sample": F.lit(True)}).unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("i", "_sample")  # a jump comes before the sample at its place
    total = F.sum("_offset").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_offset", total).where("_sample").withColumn("corrected", F.col(value) + F.col("_offset")).drop("_offset", "_sample")


def sigma_simple(df: DataFrame, keys: list[str], value: str, keep: str) -> DataFrame:
    """Standard deviation of the differences of adjacent valid samples over sqrt 2; infinite below two."""
    w = ordered(keys)
    diff = F.when(F.col(keep) & F.lag(keep).over(w), F.col(value) - F.lag(value).over(w))
    out = df.withColumn("_d", diff).groupBy(*keys).agg(F.count("_d").alias("pairs"), F.stddev_samp("_d").alias("_s"))
    return out.select(*keys, "pairs", F.when(F.col("pairs") >= 2, F.col("_s") / (2.0**0.5)).otherwise(float("inf")).alias("sigma0"))


def sigma_robust(df: DataFrame, keys: list[str], value: str, keep: str, passes: int = 3, cut: float = 5.0, least: int = 100, scale: float = 1.0, scan: tuple[str, ...] = ()) -> DataFrame:
    """Noise level from disjoint pair differences over sqrt 2, clipped *passes* times at *cut*
    levels; infinite with *least* pairs or fewer.  Pairs lie inside a *scan* of the keys.

    A pass is one aggregation to a row a key, joined back; no key's pairs meet in one task.
    """
    pair = df.groupBy(*keys, *scan, F.floor(F.col("i") / 2).alias("pair")).agg(
        F.bool_and(keep).alias("ok"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") % 2 == 0, F.col(value)).otherwise(-F.col(value))).alias("r")
    )
    left = pair.where("ok and n = 2").select(*keys, (F.col("r") / (2.0**0.5)).alias("r"))
    level = F.sqrt(F.sum(F.col("r") * F.col("r")) / F.nullif(F.count("r") - 1, F.lit(0)))
    for _ in range(passes):
        limits = left.groupBy(*keys).agg((level * cut).alias("_s"))
        left = left.join(limits, keys).where(F.abs("r") <= F.col("_s")).drop("_s")
    out = left.groupBy(*keys).agg(F.count("r").alias("pairs"), level.alias("_s"))
    known = df.select(*keys).distinct().join(out, keys, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return known.select(*keys, "pairs", F.when(F.col("pairs") > least, F.col("_s") * scale).otherwise(float("inf")).alias("sigma0"))


def level_changes(x: np.ndarray, jumping: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first sample after, offset) of the jumps that runs of *jumping* mark, and the number left out.

    A jump's offset takes the mean of the *window* valid samples after its run to that of those
    before it, both with the offsets of earlier jumps added; a run with fewer on a side is left out.

    The window before a jump reaches over a few levels, each moved by one sum of offsets, so a
    jump takes arithmetic on these sums; the means of the windows are taken for all jumps at once.
    """
    edges = np.flatnonzero(np.diff(np.concatenate([[0], jumping.astype(np.int8), [0]])))
    at = np.flatnonzero(valid)
    seen, rest = np.searchsorted(at, edges[::2]), np.searchsorted(at, edges[1::2])  # valid samples before the run and up to its end
    whole = np.minimum(seen, len(at) - rest) >= window
    seen, rest = seen[whole], rest[whole]
    if not len(seen):
        return np.array([], np.int64), np.array([]), len(whole)
    level = np.append(x[at].astype(float), 0.0)  # one more, since a window may end with the samples

    def sums(start: np.ndarray) -> np.ndarray:
        return np.add.reduceat(level, np.column_stack([start, start + window]).ravel())[::2]

    steps = (sums(seen - window) - sums(rest)) / window
    # levels, each ending where a jump's run does, of the first and the last sample of the window before
    low, high = np.searchsorted(rest, seen - window, "right"), np.searchsorted(rest, seen - 1, "right")
    ends, widths, moved = rest.tolist(), np.diff(rest), np.zeros(len(rest) + 1)
    for k, (step, first, last, end) in enumerate(zip(steps.tolist(), low.tolist(), high.tolist(), seen.tolist(), strict=True)):
        if first == last:
            moved[k + 1] = step + moved[first]
            continue
        shares = moved[first] * (ends[first] - end + window) + moved[last] * (end - ends[last - 1])
        if last - first > 1:
            shares += moved[first + 1 : last] @ widths[first : last - 1]
        moved[k + 1] = step + shares / window
    return edges[1::2][whole], np.diff(moved), int(len(whole) - len(seen))


def detect_jumps(df: DataFrame, keys: list[str], value: str, bits: int, window: int, valid: str = "valid") -> DataFrame:
    """keys, jumps (array of loc and offset, in order) and skipped for each detector-scan with a sample whose flag has one of *bits*."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, x, jumping, good = (pdf[c].to_numpy() for c in ("i", "x", "jumping", "good"))
        order = np.argsort(i, kind="stable")
        places, offsets, skipped = level_changes(x[order], jumping[order], good[order], window)
        return pd.DataFrame({k: pdf[k].iloc[:1] for k in keys} | {"loc": [places], "offset": [offsets], "skipped": skipped})[: int(jumping.any())]

    jumping = F.coalesce(F.col("flag").bitwiseAND(F.lit(bits)) != 0, F.lit(False))
    few = df.dropna(subset=keys).select(*keys, "i", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x"), jumping.alias("jumping"), F.coalesce(valid, F.lit(False)).alias("good"))
    # two plain arrays cross to Spark without an object a jump
    found = few.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", loc array<long>, offset array<double>, skipped long")
    return found.select(*keys, F.arrays_zip("loc", "offset").alias("jumps"), "skipped")


def pack_jumps(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """A catalogue's ragged jumps as a count and two plain arrays a scan."""
    return catalog.select(*keys, F.size("jumps").cast("long").alias("count"), F.transform("jumps", lambda j: j["loc"]).alias("locs"), F.transform("jumps", lambda j: j["offset"]).alias("offsets"))


def unpack_jumps(packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, loc, offset of every jump of a packed catalogue, as ``apply_jumps`` takes them."""
    both = packed.select(*keys, F.explode(F.arrays_zip("locs", "offsets")).alias("j"))
    return both.select(*keys, F.col("j.locs").alias("loc"), F.col("j.offsets").alias("offset"))


def calibration_gaps(df: DataFrame, value: str, keep: str, signal: Column, gain: Column, sigma0: Column, factor: int = 1, eta: Column | None = None) -> Column:
    """Samples that are not kept as gain times signal and, with a supplied draw, white noise of a mean over *factor* samples."""
    line = gain * signal
    line = line if eta is None else line + eta * sigma0 / float(np.sqrt(factor))
    return F.when(F.col(keep), F.col(value)).otherwise(line)


def chisq_z(df: DataFrame, keys: list[str], residual: Column, keep: Column, sigma0: Column) -> DataFrame:
    """(sum (r / sigma0)^2 - n) / sqrt(2 n) over kept samples; NaN without samples or with a bad level."""
    ok = (sigma0 > 0) & (sigma0 < float("inf"))
    use = keep & ok
    term = F.when(use, F.pow(residual / F.when(ok, sigma0), 2))
    out = df.groupBy(*keys).agg(F.sum(term).alias("_x"), F.count(term).alias("n"), F.avg(keep.cast("double")).alias("good_fraction"))
    n = F.when(F.col("n") > 0, F.col("n"))
    return out.select(*keys, "n", "good_fraction", F.coalesce((F.col("_x") - n) / F.sqrt(n * 2.0), F.lit(float("nan"))).alias("chisq_z"))
