"""Connected components of an edge table, by alternating stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours.

    The least neighbours are written down first: the join then stands on two plain
    exchanges, which Spark splits where one node has very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy(F.col("u").alias("u_")).agg(F.min("v").alias("low")), "least")
    met = both.where("v > u").join(least, F.col("u") == F.col("u_"))
    return met.select(F.col("v").alias("u"), F.least("u_", "low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them; v < u in edges."""
    least = edges.groupBy(F.col("u").alias("u_")).agg(F.min("v").alias("low"))
    met = edges.join(least, F.col("u") == F.col("u_"))
    ties = met.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return ties.unionByName(least.select(F.col("u_").alias("u"), F.col("low").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node at most, and then no other is tied to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.agg(F.count(F.when(F.col("up") + F.col("down") > 1, 1))).first()[0] == 0


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v); the root is the least node.

    Self loops and repeated edges are allowed, nulls are not. An empty table has no nodes.
    The edges are computed once. Each round is written down; rounds end when all that is
    left are stars, after a number of them that grows with the logarithm of the largest
    component.
    """
    given = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    now = given.where("u <> v")
    while not _are_stars(now):
        now = stage(_small_star(_large_star(now)), label)
    own = now.select("v", "v").union(given.where("u = v")).toDF("node", "root")
    return now.toDF("node", "root").unionByName(own).groupBy("node").agg(F.min("root").alias("root"))
