"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest, to see whether a round changed anything."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them; here b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    low = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` but the roots themselves; root: the smallest node it reaches.

    Nodes may be of any type with an order.  Each round is an aggregate and a
    join, written to the shared folder; a hub with very many links is pre-aggregated
    in the aggregate and split by the skew join.  Rounds end when the links stop changing.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    mark, i = _mark(now), 0
    while mark[0]:
        i += 1
        now = written(_small_star(_large_star(now)), f"{label}-{i}")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
