"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _join(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` with the least of their node.  The key is wrapped so that both sides are shuffled for the join and the edges of a hub can be split."""
    key = lambda c: F.bitwise_not(F.bitwise_not(c))
    return edges.join(low.select(F.col("u").alias("__u"), "m"), key(F.col("u")) == key(F.col("__u"))).drop("__u")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``links`` (a, b).

    Rounds go on until one changes nothing; their number grows with the logarithm
    of the longest chain.  Each round is two aggregations and two joins of edges; a node with very many
    neighbours is a skewed join key, which adaptive execution splits.  Only a
    count and a checksum come to the driver.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large-star: larger neighbours move to the least of the neighbourhood
        large = _join(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: smaller neighbours and the node itself move to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _join(large, least).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        new = stash(small, "edges")
        now = _state(new)
        discard(edges)
        edges = new
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
