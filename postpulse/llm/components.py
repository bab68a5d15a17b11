"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root), root the smallest node reachable.

    Alternates both star steps until nothing changes; the links are written after each round,
    so the plan stays short. Nodes without links and links to oneself don't appear.
    Minima are taken before the joins, and the joins' hot nodes are split by adaptive execution.
    """
    state = written(links.where(F.col("a") != F.col("b")).distinct(), "links")
    seen = None
    while True:
        sign = state.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.col("b") % 999_983)
        ).first()
        if sign == seen or not sign[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
        state = written(_small_star(_large_star(state)), "links")
