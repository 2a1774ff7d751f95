"""Sky components as tables: their views by polarisation, checks, updates and mixing into bands.

Views are rows (comp, class, short, pol), ``pol`` one of I, QU or IQU; amplitudes are rows (comp,
pol, l, m, re, im).  A component that is solved in intensity and in polarisation has two views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.mapmaking import small

#: Views that a component of each polarisation is solved in.
VIEWS = {"I": ("I",), "QU": ("QU",), "IQU": ("I", "QU")}


def views_of(components: DataFrame) -> DataFrame:
    """One row a view of components (comp, class, short, pol, enabled, lmax); a null lmax stays null.  An unknown polarisation is an error."""
    listed = F.create_map(*(x for k, v in VIEWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    known = F.coalesce(listed[F.coalesce("pol", F.lit("I"))], F.raise_error(F.concat(F.lit("no polarisation "), "pol")).cast("array<string>"))
    return components.where("enabled").select("comp", "class", "short", F.explode(known).alias("pol"), "lmax")


def full_lmax(nside: int) -> int:
    """The largest degree of a component that asks for all of them."""
    return nside * 5 // 2


def faults(views: DataFrame) -> DataFrame:
    """comp, fault: names that are not used as they must be, no row where all is well.

    A component has one class, one short name and each view once, and is not both split into
    views and whole; a short name belongs to one component.
    """
    by_comp = views.groupBy("comp").agg(
        F.count_distinct("class").alias("classes"),
        F.count_distinct("short").alias("shorts"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("pol").alias("pols"),
        F.max((F.col("pol") == "IQU").cast("int")).alias("whole"),
    )
    found = by_comp.select(
        "comp",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("classes") > 1, "several classes"),
                    F.when(F.col("shorts") > 1, "several short names"),
                    F.when(F.col("n") > F.col("pols"), "a view twice"),
                    F.when((F.col("whole") == 1) & (F.col("pols") > 1), "split and whole"),
                )
            )
        ).alias("fault"),
    )
    shared = views.groupBy("short").agg(F.collect_set("comp").alias("comps")).where(F.size("comps") > 1)
    return found.unionByName(shared.select(F.explode("comps").alias("comp"), F.lit("a short name of another").alias("fault")))


def joined(amplitudes: DataFrame) -> DataFrame:
    """Amplitudes of a component's views as one: I beside QU, whose coefficients are E and B.

    comp, l, m and re, im of I, E and B; a view that a component lacks is null.
    """
    i = amplitudes.where("pol = 'I'").select("comp", "l", "m", F.col("re").alias("i_re"), F.col("im").alias("i_im"))
    qu = amplitudes.where("pol <> 'I'").groupBy("comp", "l", "m").agg(*(F.max(F.when(F.col("pol") == p, F.col(c))).alias(f"{p.lower()}_{c}") for p in ("E", "B") for c in ("re", "im")))
    return i.join(qu, ["comp", "l", "m"], "full")


def split(whole: DataFrame, pol: str) -> DataFrame:
    """The rows of one view of joined amplitudes: that of I, or those of E and B."""
    fields = ("I",) if pol == "I" else ("E", "B")
    rows = F.array(*(F.struct(F.lit(f).alias("pol"), F.col(f"{f.lower()}_re").alias("re"), F.col(f"{f.lower()}_im").alias("im")) for f in fields))
    return whole.select("comp", "l", "m", F.explode(rows).alias("v")).select("comp", "l", "m", "v.*").where("re is not null")


def updated(own: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """*own* with the values of matching rows of *other*."""
    new = other.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_new"))
    both = own.join(new, keys, "left")
    return both.select(*own.columns[: len(keys)], *(F.when(F.col("_new"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values))


def unmatched(own: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of *other* that *own* has not, which an update must not have."""
    return other.select(*keys).distinct().join(own.select(*keys).distinct(), keys, "left_anti")


def to_bands(amplitudes: DataFrame, mixing: DataFrame, beam: Column) -> DataFrame:
    """Each band's coefficients: the sum over components of mixing times amplitude, smoothed by the band's *beam* (of l and band columns).

    *mixing* has a row for each band and component (comp, band, factor and the beam's columns).
    """
    mixed = amplitudes.join(small(mixing, 1 << 16), "comp")
    return mixed.groupBy("band", "l", "m").agg(*(F.sum(F.col("factor") * beam * F.col(c)).alias(c) for c in ("re", "im")))


def from_bands(bands: DataFrame, mixing: DataFrame, beam: Column) -> DataFrame:
    """The adjoint of ``to_bands``: each component's sum over bands."""
    mixed = bands.join(small(mixing, 1 << 16), "band")
    return mixed.groupBy("comp", "l", "m").agg(*(F.sum(F.col("factor") * beam * F.col(c)).alias(c) for c in ("re", "im")))


def mixed_by_pixel(amplitude: DataFrame, factor: DataFrame) -> DataFrame:
    """Mixing that varies over the sky: each pixel's amplitude (comp, pix, value) times its own factor (comp, band, pix, factor), summed a band."""
    return amplitude.join(factor, ["comp", "pix"]).groupBy("band", "pix").agg(F.sum(F.col("value") * F.col("factor")).alias("value"))


def residual(data: DataFrame, sky: DataFrame, active: list[str]) -> DataFrame:
    """Band maps less the components that are held fixed: those of *sky* (band, comp, pix, value) not in *active*."""
    fixed = sky.where(~F.col("comp").isin(active)).groupBy("band", "pix").agg(F.sum("value").alias("_fixed"))
    return data.join(fixed, ["band", "pix"], "left").select("band", "pix", (F.col("value") - F.coalesce("_fixed", F.lit(0.0))).alias("value"))


def scaled_sum(a: DataFrame, b: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """Coefficients a + factor b where both have them."""
    other = b.select(*keys, F.col("re").alias("_re"), F.col("im").alias("_im"))
    return a.join(other, keys).select(*keys, *((F.col(c) + F.col(f"_{c}") * factor).alias(c) for c in ("re", "im")))


def prior_root(amplitudes: DataFrame, spectrum: Column, inverse: bool = False) -> DataFrame:
    """Amplitudes times the root of a prior spectrum of l; the inverse leaves 0 where there is none."""
    root = F.sqrt(F.when(spectrum > 0, spectrum))
    by = (F.lit(1.0) / root) if inverse else root
    return amplitudes.withColumns({c: F.coalesce(F.col(c) * by, F.lit(0.0)) for c in ("re", "im")})


def anisotropies(amplitudes: DataFrame) -> DataFrame:
    """Coefficients without monopole, dipole and quadrupole."""
    return amplitudes.where("l > 2")
