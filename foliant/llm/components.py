"""Connected components of a graph in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (columns a and b); component is the smallest node reachable.

    Every step sums up before it shuffles and joins its neighbour lists only through their minimum, so no list is
    gathered in one row. Lineage is cut each round in the checkpoint folder. The number of rounds grows with the
    logarithm of the number of nodes; running out of rounds is an error, not a partial result.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        # Large star: every neighbour above a node goes to the smallest of the node and its neighbours.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
        mark = now
    raise RuntimeError(f"components are not final after {max_rounds} rounds")
