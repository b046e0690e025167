"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(node, low): the least of a node and its neighbours. Partial sums come before the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``links`` with the least node that it reaches.

    Every round writes its links to the shared folder, so that a lost executor costs one round at most.
    A node's links are never gathered into one row: rounds are joins and sums.
    """
    now = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: a node's larger neighbours move to its least neighbour.
        large = both.filter("b > a").join(_least(both).withColumnRenamed("node", "a"), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large-star")
        # Small star: a node and its smaller neighbours move to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        small = materialize(small, "small-star")
        new = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        discard(large)
        now = small
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
