"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on edges a > b: every neighbour of a node moves to the lowest
    node around it; ``large`` moves the higher neighbours, else the lower ones.

    The lowest neighbour is an aggregate that is summed per task first, and is
    joined back, so the neighbours of a node are never gathered.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = around.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        rest = edges.join(low, "a")
        moved = rest.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.withColumnRenamed("low", "b"))
    return moved.filter("a <> b").select("a", "b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with an edge downwards has one only and nothing above it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (the lowest node reached) of every node that has a link.

    ``links`` has a and b; loops are ignored. Alternating large and small stars
    end when every edge points from a node to the lowest of its component.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while not _are_stars(edges):
        edges = written(_star(_star(edges, True), False), "components")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select("b", "b").toDF("node", "component").distinct())
