"""Connected components of a large edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of ``edges`` (a, b: long), stored.

    Each round hangs the larger neighbours of a node, then the smaller ones, below the least one; the
    number of edges never grows and the depth falls by a power, so a few rounds do even for chains.
    Minima are pre-aggregated before the shuffle, so a node with very many neighbours is no hot spot.
    Edges that are loops are left out, and so are nodes with loops only.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # a forest of stars is done: no node is above one edge and below another
        if e.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").isEmpty() and e.select("a").join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return stored(e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "components")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").select("a", "b", "m")
        e = stored(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(under.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-star")
