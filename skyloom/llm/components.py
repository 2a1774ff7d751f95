"""Connected components of an edge table, by rounds of minimum-neighbour contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of *edges* (a, b: long); root is the smallest node reachable.

    Each round points every node to its smallest neighbour (itself included), follows the
    pointers once more, and replaces the ends of the edges by the pointers' targets, so trees
    of edges shrink at least by half; edges inside a target vanish.  All steps are keyed
    aggregations with a map-side part, or joins with a table of one row a node; a hub's
    edges are therefore never gathered, and AQE may split its side of a join.
    """
    edges = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    k, levels = 0, []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        up = scratch.write(up, f"{name}-up{k}")
        twice = up.alias("x").join(up.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))
        jump = scratch.write(twice, f"{name}-jump{k}")
        levels.append(jump)
        moved = (
            edges.join(jump.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(jump.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        edges = scratch.write(moved, f"{name}-edges{k + 1}")
        scratch.drop(f"{name}-edges{k}", f"{name}-up{k}")
        k += 1
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node that is a target at one level is found again at the next one, unless it is a root
    out = levels[-1].select("node", F.col("to").alias("root"))
    for level in reversed(levels[:-1]):
        last = out.select(F.col("node").alias("to"), "root")
        out = level.join(last, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out
