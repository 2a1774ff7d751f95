"""Helpers shared by the text operators: shared storage, Arrow maps and byte-level words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of every text contract here.
SPACES = b"\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset on one machine (tests) a temporary folder is made and set; on a
    cluster, whose executors would not see it, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage between the steps of one operator run.

    A written table outlives any executor.  ``drop`` removes one as soon as a later one
    replaces it; what a lazy result still reads stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write *df* and return it read back with the schema it was written with."""
        df.write.option("compression", "zstd").parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can neither clash nor be moved."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).cast("binary").alias(name)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, block: int = 1024) -> DataFrame:
    """``mapInArrow`` for a function from columns of Python lists to columns of lists.

    The output types are those of *schema*.  At most *block* rows of an Arrow batch are
    Python objects at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                out = rows({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def lower_words(text: bytes) -> list[bytes]:
    """The contract's words of a text with A-Z lower-cased (``bytes`` methods are ASCII-only)."""
    return text.lower().split()


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).collect()[0][0]


class Keyed:
    """The rows of a table so that each can be told apart: by doc_id where no other row has it,
    otherwise (null or repeated doc_id) by a number of its own, for which those rows are written.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch) -> None:
        self.docs = docs
        repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
        repeated = scratch.write(repeated, "repeated")
        self.plain = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select(docs.columns)
        odd = docs.join(repeated, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
        self.odd = scratch.write(odd.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "odd")

    def texts(self) -> DataFrame:
        """doc_id, row (null where doc_id is enough) and text of every row."""
        plain = self.plain.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("row"), "text")
        return plain.unionByName(self.odd.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "row", F.col("doc.text").alias("text")))

    def without(self, gone: DataFrame) -> DataFrame:
        """The rows, all columns, that *gone* (doc_id, row) does not name."""
        plain = self.plain.join(gone.where("row is null").select("doc_id"), "doc_id", "left_anti").select(self.docs.columns)
        odd = self.odd.join(gone.where("row is not null").select("row"), "row", "left_anti").select("doc.*")
        return plain.unionByName(odd)


def even_share(df: DataFrame, total: int, least: int, most: int) -> int:
    """An even share of *total* for each of the shuffle's tasks, within the bounds."""
    return max(least, min(most, total // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
