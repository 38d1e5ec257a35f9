"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise

EDGES_A_TASK = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _write(df: DataFrame, name: str, edges: int) -> DataFrame:
    """df written by a task for each EDGES_A_TASK edges, so that small graphs take short rounds."""
    return materialise(df.coalesce(edges // EDGES_A_TASK + 1), name)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least", n)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = _write(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least", n)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v): the least node reachable.

    Each round writes its edges to the shared folder; the number of rounds grows
    with the logarithm of the graph.  Hubs are met by pre-aggregated minima, which are
    written first, so that Spark can split the joins with them.
    """
    now = materialise(edges.select("u", "v").where("u != v").distinct(), "cc-edges")
    state = _state(now)
    while state[0]:
        wide = _write(_large_star(now, state[0]), "cc-wide", state[0])
        now = _write(_small_star(wide, state[0]).distinct(), "cc-edges", state[0])
        if (new := _state(now)) == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
