"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b) of longs: root is the smallest node of the component.

    Large-star and small-star steps; a node's neighbours are reduced by aggregation (min), never collected. Ends after
    O(log n) rounds, each one shuffle of at most the distinct edges.
    """
    e = cut(edges.filter("a <> b AND a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # Merge joins throughout: both sides grow with the data, and a small one that the optimiser would rather broadcast
    # costs the driver a hash table of 64 MB in every round.
    before = None
    while True:
        # Large star: every larger neighbour of u is tied to the least of u's neighbourhood.
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.filter("m > n").join(least.hint("merge"), "n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        # Small star: what is left below a node is tied to its least.
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").union(low.select("u", F.col("low").alias("v")))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
