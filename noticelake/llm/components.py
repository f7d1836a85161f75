"""Connected components by alternating large-star and small-star steps, as DataFrame joins.

Each step replaces every edge by one that points at the smallest neighbour; the number of
edges never grows, and chains halve.  Labels stay distributed; only two numbers (edge count
and checksum) reach the driver each round, to see whether anything still changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = both if large else both.where("b < a")
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # a node's smaller neighbours, and the node itself, point at the smallest of them
        moved = sides.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), any direction, repeats allowed -> (node, component) for every node with an edge.

    component is the smallest node that can be reached.  No edges: an empty table.  Self-loops
    are ignored.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    total = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))
    seen = None
    while (state := tuple(now.agg(F.count("*"), total).first())) != seen and state[0]:
        seen = state
        now = stored(_star(_star(now, large=True), large=False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
