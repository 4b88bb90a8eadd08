"""Connected components by alternating large-star and small-star rounds over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of edges (a, b: long) reaches.

    Only minima are taken per node, combined before each shuffle, so a node with any number of neighbours costs one row
    a task; the join back is a shuffled join that adaptive execution can split. Nodes without an edge to another node
    are not in the result; no edges give no rows.
    """
    flat = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(flat)
    while True:
        both = flat.union(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        flat = written(linked.where("a <> b").distinct())
        after = state(flat)
        if after == before:
            break
        before = after
    tops = flat.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return flat.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
