"""Connected components of a graph given as rows, by alternating stars.

Each round joins every node to the smallest node it knows of; the number of rounds grows with the logarithm of the graph.
A node with very many links is summed inside the tasks before the shuffle, and joins on it are ones that adaptive execution
can split. Rounds are written to the shared folder, so a lost executor costs no more than the round it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglark.session import materialize


def _toward_least(edges: DataFrame) -> DataFrame:
    """(a, b) -> a with the least node that it is linked to, itself included, beside each of its links."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _toward_least(both).where("b > a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _toward_least(down)
    return near.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) that is not the least of its component; ``root`` is the least one."""
    edges = materialize(links.select("a", "b").where("a <> b"), "links")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
