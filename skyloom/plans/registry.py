"""All registered queries on the driver tables and their SQL.

``register`` takes a query and its SQL with the names of exact and of rounded columns; both
sides are cut to these and rounded alike, since the order of a sum shows in its last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.sources.driver_tables import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Inventory identifiers that each query covers.
COVERS: dict[str, tuple[str, ...]] = {}


def register(covers: str, exact: str, rounded: str = "", sql: str | None = None, digits: int = 4, name: str | None = None):
    """Decorator: registers a function of (spark, sf_dir) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        keep, cut = exact.split(), rounded.split()

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*keep, *((F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in cut))

        QUERIES[key] = query
        COVERS[key] = tuple(covers.split())
        if sql is not None:
            columns = ", ".join([*keep, *(f"round(CAST({c} AS DOUBLE), {digits}) + 0e0 AS {c}" for c in cut)])
            ORACLE[key] = f"SELECT {columns} FROM ({with_views(sql)}) q"
        return f

    return add


from skyloom.plans import grouped, maps, scans, sky, timeline  # noqa: E402, F401  (they register themselves)
