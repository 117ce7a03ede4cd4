"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.llm import common


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``edges(a, b)``.  Each step is one
    aggregation and one join; neighbour lists are never gathered.  Edges are cut from their lineage after each pair of
    steps, in the shared folder."""
    edges = common.materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large star: each neighbour above a node goes to the smallest of the node and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, edges = edges, common.materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        common.drop(old)
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    own = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.union(own).select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
