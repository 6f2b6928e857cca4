"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and joins over the edge list, and the rounds grow with the
logarithm of the longest path, not its length.  The minima combine on the map side.  They are cut
before they are joined: adaptive execution splits a node with very many neighbours only where both
sides of the join are plain exchanges, not where one is an aggregate of the same exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger, or else the smaller ones and itself) move to its smallest neighbour."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = cut(down.groupBy("a").agg(F.min("b").alias("m")))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge (a, b long, not null)."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    state = _state(edges)
    while True:
        edges = cut(_star(cut(_star(edges, large=True)), large=False))
        state, before = _state(edges), state
        if state == before:
            break
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
