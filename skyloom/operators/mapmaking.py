"""Binned map-making: projection, masks, per-pixel normal equations and their solution.

All functions are lazy.  A map is one aggregation keyed by pixel, whose partial sums are at
most one row a pixel and task, followed by algebra on the aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import linalg, stokes
from skyloom.functions.geometry import with_coarser

PACKED = ("a_ii", "a_iq", "a_iu", "a_qq", "a_qu", "a_uu")
RHS = ("b_i", "b_q", "b_u")
#: Rows of a map or mask below which it is broadcast to the samples; larger ones are joined by shuffle.
BROADCAST_PIXELS = 12 * 512 * 512


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a side of a known number of *rows*, within the bound only."""
    return F.broadcast(df) if rows <= BROADCAST_PIXELS else df


def good(flag: Column, bits: int) -> Column:
    """No bit of *bits* is set."""
    return flag.bitwiseAND(F.lit(bits)) == 0


def with_sky(samples: DataFrame, sky: DataFrame, npix: int, columns: tuple[str | None, str | None, str | None] = ("s_i", "s_q", "s_u"), out: str = "signal") -> DataFrame:
    """Samples with the sky's signal; a pixel that the sky lacks has none."""
    i, q, u = (F.col(c) if c else None for c in columns)
    return samples.join(small(sky, npix), "pix", "left").withColumn(out, stokes.project(F.col("psi"), i, q, u))


def masked(samples: DataFrame, npix: int, named: DataFrame | None = None, default: DataFrame | None = None) -> DataFrame:
    """``keep`` of the named mask, else of the default mask, else true."""
    out, found = samples, []
    for name, m in (("_named", named), ("_default", default)):
        if m is not None:
            out = out.join(small(m.select("pix", F.col("keep").alias(name)), npix), "pix", "left")
            found.append(F.col(name))
    return out.withColumn("keep", F.coalesce(*found, F.lit(True))).drop("_named", "_default")


def normal_sums(weight: Column, psi: Column, r_i: Column | float = 1.0, r_qu: Column | float = 1.0) -> list[Column]:
    """The six sums of the packed normal matrix."""
    p = stokes.response(psi, r_i, r_qu)
    pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    return [F.sum(weight * p[j] * p[k]).alias(n) for (j, k), n in zip(pairs, PACKED, strict=True)]


def rhs_sums(weight: Column, tod: Column, psi: Column, r_i: Column | float = 1.0, r_qu: Column | float = 1.0, names: tuple[str, ...] = RHS) -> list[Column]:
    return [F.sum(weight * tod * p).alias(n) for p, n in zip(stokes.response(psi, r_i, r_qu), names, strict=True)]


def normal_equations(samples: DataFrame, keys: list[str], weight: Column, tod: Column, r_i: Column | float = 1.0, r_qu: Column | float = 1.0) -> DataFrame:
    psi = F.col("psi")
    return samples.groupBy(*keys).agg(*normal_sums(weight, psi, r_i, r_qu), *rhs_sums(weight, tod, psi, r_i, r_qu), F.count(F.lit(1)).alias("hits"))


def solve_maps(equations: DataFrame, keys: list[str]) -> DataFrame:
    """I, Q, U and their rms a pixel; singular pixels have value 0 and infinite rms."""
    a, b = [F.col(c) for c in PACKED], [F.col(c) for c in RHS]
    x, r = linalg.solve(a, b), linalg.rms(a)
    values = [v.alias(n) for v, n in zip([*x, *r], ("s_i", "s_q", "s_u", "rms_i", "rms_q", "rms_u"), strict=True)]
    return equations.select(*keys, "hits", *values)


def intensity_map(samples: DataFrame, keys: list[str], weight: Column, tod: Column) -> DataFrame:
    """Weighted mean and rms a pixel; without weight 0 and infinity."""
    sums = samples.groupBy(*keys).agg(F.sum(weight * tod).alias("b"), F.sum(weight).alias("a"), F.count(F.lit(1)).alias("hits"))
    ok = F.col("a") > 0
    safe = F.when(ok, F.col("a"))
    return sums.select(
        *keys, "hits", F.coalesce(F.col("b") / safe, F.lit(0.0)).alias("s_i"), F.coalesce(F.lit(1.0) / F.sqrt(safe), F.lit(float("inf"))).alias("rms_i")
    )


def full_sky(maps: DataFrame, pixels: DataFrame, values: dict[str, float]) -> DataFrame:
    """Every pixel of the sky; unhit ones have the given values."""
    return pixels.join(maps, "pix", "left").fillna(values)


def degrade(maps: DataFrame, nside_in: int, nside_out: int, value: str) -> DataFrame:
    """Average of the children of each coarser pixel."""
    return with_coarser(maps, nside_in, nside_out).groupBy("pix").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("children"))


def degrade_rms(maps: DataFrame, nside_in: int, nside_out: int, rms: str) -> DataFrame:
    """rms of the average weight: 1 / sqrt(mean(1 / rms^2)); infinite without weight."""
    weight = F.avg(F.when(F.col(rms) > 0, F.lit(1.0) / (F.col(rms) * F.col(rms))).otherwise(0.0))
    out = with_coarser(maps, nside_in, nside_out).groupBy("pix").agg(weight.alias("w"))
    return out.select("pix", F.when(F.col("w") > 0, F.lit(1.0) / F.sqrt(F.when(F.col("w") > 0, F.col("w")))).otherwise(float("inf")).alias(rms))


def mixing_sums(channels: DataFrame, key: str, mixing: list[Column], data: Column, weight: Column, eta: Column | None = None) -> DataFrame:
    """Sums of the component system M^T N^-1 M a = M^T (N^-1 d + N^-1/2 eta) a pixel."""
    source = weight * data if eta is None else weight * data + F.sqrt(weight) * eta
    sums = [F.sum(mi * mj * weight).alias(f"m{i}{j}") for i, mi in enumerate(mixing) for j, mj in enumerate(mixing) if j >= i]
    return channels.groupBy(key).agg(*sums, *(F.sum(m * source).alias(f"y{i}") for i, m in enumerate(mixing)))


def fused_equations(samples: DataFrame, accepted: DataFrame, scan: list[str], keys: list[str], weight: Column, streams: dict[str, Column]) -> DataFrame:
    """Normal matrix, hits and the right sides {name}0..2 of several streams of the samples of accepted
    detector-scans, in one aggregation."""
    psi = F.col("psi")
    sums = [*normal_sums(weight, psi), F.count(F.lit(1)).alias("hits")]
    for name, value in streams.items():
        sums += rhs_sums(weight, value, psi, names=tuple(f"{name}{k}" for k in range(3)))
    return samples.join(accepted, scan, "left_semi").groupBy(*keys).agg(*sums)


def solve_fused(equations: DataFrame, keys: list[str], streams: tuple[str, ...]) -> DataFrame:
    """{name}_i, _q, _u of each stream, and {first stream}_rms of the intensity, which all streams share."""
    a = [F.col(c) for c in PACKED]
    out = [c.alias(f"{name}_{p}") for name in streams for p, c in zip("iqu", linalg.solve(a, [F.col(f"{name}{k}") for k in range(3)]), strict=True)]
    return equations.select(*keys, "hits", *out, linalg.rms(a)[0].alias(f"{streams[0]}_rms"))


def pixel_index(seen: DataFrame, keys: list[str], npix: int, ranges: int = 1024) -> DataFrame:
    """Dense index of the distinct pixels of each key, in order of the pixel.

    Pixels are ranked inside one of *ranges* ranges; a range starts where the counts of those
    below it end, so no task ranks all pixels of a key.
    """
    width = -(-npix // ranges)
    at = seen.select(*keys, "pix").distinct().withColumn("_range", F.floor(F.col("pix") / width))
    counts = at.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # at most *ranges* rows a key
    below = counts.withColumn("_below", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("pix")) - 1
    return at.withColumn("_rank", rank).join(below, [*keys, "_range"]).select(*keys, "pix", (F.col("_below") + F.col("_rank")).cast("long").alias("local"))


def threshold_mask(mask: DataFrame, nside_in: int, nside_out: int, above: float = 0.5) -> DataFrame:
    """``keep`` of each coarser pixel: its children's mean is above *above*."""
    return with_coarser(mask, nside_in, nside_out).groupBy("pix").agg((F.avg(F.col("keep").cast("double")) > above).alias("keep"))


def keeps_all(mask: DataFrame) -> bool:
    """A mask that keeps every pixel selects nothing, and callers leave it out."""
    return mask.where(~F.col("keep")).isEmpty()


def solve_two(sums: DataFrame, key: str) -> DataFrame:
    """Two components a pixel; 0 where the system is singular."""
    det = F.col("m00") * F.col("m11") - F.col("m01") * F.col("m01")
    ok = F.when(det > F.col("m00") * F.col("m11") * linalg.SINGULAR, det)
    one = (F.col("m11") * F.col("y0") - F.col("m01") * F.col("y1")) / ok
    two = (F.col("m00") * F.col("y1") - F.col("m01") * F.col("y0")) / ok
    return sums.select(key, F.coalesce(one, F.lit(0.0)).alias("c0"), F.coalesce(two, F.lit(0.0)).alias("c1"))


def conjugate_gradient(samples: DataFrame, keys: list[str], weight: Column, tod: Column, iterations: int = 60, tolerance: float = 1e-26) -> DataFrame:
    """The binned solution by preconditioned conjugate gradients, where a direct one is not wanted.

    The operator P^T N^-1 P of white noise is one packed matrix a pixel, so an iteration is
    algebra and four scalar sums; samples are read once (``unbinned`` has the operator of samples).  Vectors are checkpointed
    every few iterations in the shared folder, which bounds lineage and survives lost executors.
    """
    base = normal_equations(samples, keys, weight, tod).where("a_ii > 0")
    a = [F.col(c) for c in PACKED]
    diagonal = [a[0], a[3], a[5]]
    inv = [F.when(d > 0, F.lit(1.0) / F.when(d > 0, d)).otherwise(0.0) for d in diagonal]
    names = ("x", "r", "p")
    state = base.select(*keys, *PACKED, *(F.lit(0.0).alias(f"x{k}") for k in range(3)), *(F.col(b).alias(f"r{k}") for k, b in enumerate(RHS)), *(
        (F.col(b) * inv[k]).alias(f"p{k}") for k, b in enumerate(RHS)
    )).checkpoint()
    col = {n: [F.col(f"{n}{k}") for k in range(3)] for n in names}
    dot = lambda u, v: F.sum(sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0)))
    rz = state.agg(dot(col["r"], [r * i for r, i in zip(col["r"], inv, strict=True)])).first()[0] or 0.0
    first = rz
    for step in range(iterations):
        if not first or rz <= tolerance * first:
            break
        image = linalg.multiply(a, col["p"])
        alpha = rz / state.agg(dot(col["p"], image)).first()[0]
        moved = state.select(
            *keys, *PACKED, *((x + p * alpha).alias(f"x{k}") for k, (x, p) in enumerate(zip(col["x"], col["p"], strict=True))),
            *((r - q * alpha).alias(f"r{k}") for k, (r, q) in enumerate(zip(col["r"], image, strict=True))), *(f"p{k}" for k in range(3)),
        )
        new = moved.agg(dot(col["r"], [r * i for r, i in zip(col["r"], inv, strict=True)])).first()[0]
        state = moved.select(*keys, *PACKED, *(f"x{k}" for k in range(3)), *(f"r{k}" for k in range(3)), *((col["r"][k] * inv[k] + col["p"][k] * (new / rz)).alias(f"p{k}") for k in range(3)))
        if step % 4 == 3:
            state = state.checkpoint()
        rz = new
    return state.select(*keys, F.col("x0").alias("s_i"), F.col("x1").alias("s_q"), F.col("x2").alias("s_u"))
