"""Connected components of an edge table, by alternating stars.

Each step is one aggregation and one join on node ids, so a node with very many
edges is combined on the map side and its join partition can be split. Steps are
written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.session import write_table


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with an edge; component is the smallest reachable node.

    Loops, repeated and reversed edges and rows with a null end change nothing.
    An empty table gives no rows.
    """
    start = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v"),
    ).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    current = write_table(start, "edges")
    state = _state(current)
    while state[0]:
        current = write_table(_small_star(_large_star(current)), "edges")
        new = _state(current)
        if new == state:
            break
        state = new
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
