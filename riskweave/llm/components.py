"""Connected components of a link table by alternating star contraction.

In each round every node's neighbours are linked to the smallest node among
them (first the larger ones, then the smaller ones), by joins against one
minimum a node; no neighbourhood is ever gathered. Rounds end when every link
points from a member to its component's smallest node, after about log n of
them. Each round is a written table, so lost executors lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (a > b): each neighbour above u is linked to u's smallest neighbour or u."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (a > b): the smaller neighbours of a, and a, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return down.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two comparable columns
    a, b, any order); the component is its smallest node. Self links and
    repeated links do no harm; an empty table gives an empty result."""
    a, b = F.col("a"), F.col("b")
    edges = keep(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "cc")
    for _ in range(MAX_ROUNDS):
        # done when no node points to two others and no target points further
        nodes = edges.groupBy("a").agg(F.count("*").alias("n"))
        if edges.join(nodes.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and nodes.filter("n > 1").isEmpty():
            break
        edges = keep(_small_star(_large_star(edges)), "cc")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
