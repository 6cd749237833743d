"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, written


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)`` is the ``u`` of one row and no ``v``, or only ``v``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    return ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top")).filter("low > 1 or (low = 1 and top = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links(a, b)``; label is the least node of the component. A written table.

    A union-find whose forest is a table: a round hooks every node onto the least node among its neighbours (large star),
    then flattens the trees (small star), until the links are stars: no node hangs on two others, or on one that hangs itself.
    Rounds grow as the logarithm of the longest path; sums are taken before each shuffle, and the links of one node, when joined,
    may be split over tasks.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # a table, so that adaptive execution can split the links of one node
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
        discard(old, least)
    roots = edges.select("v").distinct()
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
    labels = written(ends, "labels")
    discard(edges)
    return labels
