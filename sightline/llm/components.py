"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b: link neighbours to the smallest one.

    The large step links the greater neighbours of a node, the small step the smaller ones and the node.
    Both keep what is connected; a hub costs one row per neighbour.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    near = both.join(low, "a")
    if large:
        linked = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        linked = near.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b"))
        )
    return linked.where(F.col("a") != F.col("b")).distinct()


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node reachable.

    Edges may repeat, point either way or to themselves; edges with a null end are left out. Nodes only
    in edges to themselves are left out.
    """
    now = staged(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = _print(now)
    while seen[0]:
        now = staged(_star(_star(now, True), False), "edges")
        after = _print(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
