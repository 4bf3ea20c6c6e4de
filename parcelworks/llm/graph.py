"""Connected components of an edge table in rounds of joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the other smaller) neighbours of every node, and the node itself, to its least neighbour."""
    sides = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = sides.join(least, "a")
    tied = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return tied.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a long, b long): ``label`` is the least node of its component.

    Alternates the large and the small star until every node hangs on its component's least node, in a number of rounds that grows
    with the logarithm of the longest path. Each round is a written table.
    """
    edges = materialize(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    mark = None
    while True:
        edges = materialize(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if mark == tuple(now):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = tuple(now)
