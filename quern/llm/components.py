"""Connected components of a graph held as an edge table, by alternating large and small stars.

Nothing is collected: each round is a few joins and partially aggregated minima,
and its edges are checkpointed in the shared folder, so a lost executor costs one
round at most. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to its least neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Is each left node once there, and no right node a left one?"""
    repeated = edges.groupBy("a").count().filter("count > 1").select("a")
    chained = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").select(F.col("b").alias("a"))
    return repeated.unionByName(chained).isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) of orderable ids to (node, root): the least node of each component, for all nodes but the roots.

    Null ends, loops, repeated and reversed links are allowed; an empty table gives an empty one.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    while not _settled(edges):
        edges = checkpointed(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
