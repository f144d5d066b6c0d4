"""Connected components of a link table by alternating stars, on written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Each node hands its least neighbour to its larger (or its smaller) neighbours.

    The least neighbour is a partial aggregate, so a node with very many links is no single group.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component_id) of every node with a link; component_id is the least node reachable. links: (a, b) bigint."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if mark == state or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(edges.select(F.col("b"), F.col("b")).distinct())
        state = mark
        edges = written(_star(_star(edges, True), False), "links")
