"""Sinks: chains of maps, components and sampled parameters as partitioned Parquet, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_chain(df: DataFrame, path: str, chain: int, iteration: int, keys: tuple[str, ...] = ("band",), every: int = 1, chains: tuple[int, ...] | None = None) -> bool:
    """Write one iteration; False if the interval or the list of chains leaves it out.

    Rewriting an iteration replaces its partitions only, so a restarted run repeats safely.
    """
    if iteration % every or (chains is not None and chain not in chains):
        return False
    out = df.withColumns({"chain": F.lit(chain), "iter": F.lit(iteration)})
    parts = ["chain", "iter", *keys]
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return True


def read_chain(spark, path: str, chain: int, iteration: int | None = None) -> DataFrame:
    """An iteration of a chain, the last one by default; partitions of others are not read."""
    df = spark.read.parquet(path).where(F.col("chain") == chain)
    if iteration is None:
        iteration = df.agg(F.max("iter")).first()[0]
    return df.where(F.col("iter") == iteration)


def write_manifest(scans: DataFrame, path: str) -> None:
    """Text manifest of pid and path, in order of pid."""
    line = F.concat(F.col("pid").cast("string"), F.lit(' "'), F.col("path"), F.lit('" 1 0.0 0.0'))
    scans.orderBy("pid").select(line).write.mode("overwrite").text(path)


def flat_form(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ragged arrays as lengths and one concatenated array, in order of the keys.

    The whole column becomes one row, so this is for exports of small results only.
    """
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("v"))))
    return df.agg(rows.alias("r")).select(F.transform("r", lambda x: F.size(x["v"])).alias("lengths"), F.flatten(F.transform("r", lambda x: x["v"])).alias("flat"))


def write_parameters(spark, path: str, parameters: dict, chain: int) -> None:
    """A run's parameters beside its chain, as one row of JSON."""
    spark.createDataFrame([(chain, json.dumps(parameters, sort_keys=True))], "chain int, parameters string").write.mode("overwrite").parquet(f"{path}/_parameters")


def read_parameters(spark, path: str) -> dict:
    """The parameters of the first chain that has any."""
    row = spark.read.parquet(f"{path}/_parameters").where("parameters is not null").orderBy("chain").first()
    if row is None:
        raise ValueError(f"{path} has no parameters")
    return json.loads(row["parameters"])


def write_diagnostics(equations: DataFrame, maps: DataFrame, path: str, keys: tuple[str, ...] = ("band",)) -> StructType:
    """Sky, hits, rms and the six numbers of the normal matrix of each pixel, one directory a band.

    The schema is returned for reading: without a pixel no file is written that would tell it.
    """
    packed = equations.select(*keys, "pix", "a_ii", "a_iq", "a_iu", "a_qq", "a_qu", "a_uu")
    table = maps.join(packed, [*keys, "pix"])
    table.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return table.schema
