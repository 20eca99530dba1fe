"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch, small


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges``: (a, b), rows of written tables. Returns (node, root) with the smallest reachable node as root, for every
    node of an edge. Minima are map-side aggregates and joins, so that a hub's neighbours are never
    gathered; each round is written, so that lineage stays short. One aggregate per round gives the minima and
    tells whether all is done."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    written = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.groupBy("u").agg(F.min("v").alias("m"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"), F.max("v").alias("top"))
        ends = scratch.keep(ends, "ends")
        # Stars: a node with a smaller neighbour has that one alone.
        if ends.where("below <> m or below is not null and top > u").isEmpty():
            if written is not None:
                scratch.drop(written)
            return ends.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        low = small(ends, ends.select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        large = e.join(low, "v").select("u", F.col("m").alias("v"))
        low = small(ends, large.groupBy("u").agg(F.min("v").alias("m")))
        # A node's edge to its least neighbour stays, each other neighbour gets one to it: as many edges as before at most.
        step = large.join(low, "u").select(F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v"))
        following = scratch.keep(step, "edges")
        scratch.drop(ends)
        if written is not None:
            scratch.drop(written)
        e = written = following
