"""Connected components of an edge table, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.store import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to the smallest node next to it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; the root is its least node.

    Star contraction in rounds: the number of rounds grows with the logarithm of a
    component's size. Minima combine before the shuffle, so a node with very many
    neighbours is no hot group; each round is a written table.
    """
    larger = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    at = stored(larger.distinct(), "edges")
    mark = state(at)
    while True:
        at = stored(small_star(large_star(at)).distinct(), "edges")
        now = state(at)
        if now == mark:
            break
        mark = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        at.select("b", "b").distinct()
    )


def state(edges: DataFrame) -> tuple:
    """Count and checksum of an edge table, to see whether a round changed it."""
    mixed = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(mixed.cast("decimal(20,0)"))).first()
    return tuple(row)
