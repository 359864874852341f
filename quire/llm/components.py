"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.shared import discard, materialize


def smallest_above(edges: DataFrame) -> DataFrame:
    """large star: every neighbour above a node is linked to the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def smallest_below(edges: DataFrame) -> DataFrame:
    """small star, of edges with a > b: a node's lower neighbours, and itself, are linked to the lowest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its smallest node) for each node of ``links(a, b)``.

    Links may repeat, stand either way or join a node to itself; nodes without a link to another one aren't
    returned. Each round is a few hash joins and partial aggregates over links, written to the shared folder;
    the rounds grow with the logarithm of the longest chain. A hub's links are a skewed join side, which
    adaptive execution splits.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(limit):
        old, edges = edges, materialize(smallest_below(smallest_above(edges)), "stars")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {limit} rounds")
