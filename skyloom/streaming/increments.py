"""Structured Streaming: event-time summaries and maps that grow with arriving scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import mapmaking as mm


def read_events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Files of events as a stream; ``ts`` becomes a timestamp that a watermark accepts."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of tumbling event-time windows; rows later than *late* are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key: runs of events without a gap of *gap*."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def map_increments(samples: DataFrame, keys: list[str], weight, tod) -> DataFrame:
    """Running normal equations a pixel; they are sums, so state is one row a pixel."""
    return mm.normal_equations(samples, keys, weight, tod)


def solve_batch(path: str, keys: list[str]):
    """foreachBatch sink that solves the changed pixels of a batch and writes them under the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        mm.solve_maps(batch, keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
