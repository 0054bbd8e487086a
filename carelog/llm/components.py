"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b).

    Each round hooks every node to the smallest neighbour of the nodes around it
    (a minimum per key, so no neighbour list is gathered), first over larger, then
    over smaller neighbours, until the edges are stars.  Rounds grow with the
    logarithm of the longest chain.  Nodes without an edge do not appear.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b"))
        large = saved(large, "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = saved(large.join(down, "a").select(F.col("b").alias("x"), "m").unionAll(down.select(F.col("a").alias("x"), "m"))
                      .where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        discard(now, large)
        # stars: every node has one edge to a smaller one, or is that smaller one of others
        ends = small.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(small.select("b", F.lit(0), F.lit(1)))
        bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count()
        if not bad:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = small
