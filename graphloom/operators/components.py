"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its least node.

    Each pass is two shuffles of the edges and ends in the shared folder; their number grows with the logarithm of the
    diameter. Hubs are partitions of a window, which spills, and never lists in memory.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    by = Window.partitionBy("u")
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.distinct().withColumn("m", F.min("v").over(by))
        now = cut(small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
