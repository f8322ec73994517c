"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.session import materialise


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node that edges reach. Nodes are longs; loops and nulls are ignored.

    Alternating star contraction: each round links all larger neighbours of a node to the smallest one, then all
    smaller neighbours, until nothing changes; the number of rounds grows with the logarithm of a component's size.
    Minima are combined before the shuffle, so a node with many edges does not gather them in one task.
    """
    def points(df: DataFrame, u, v) -> DataFrame:
        return df.select(u.alias("u"), v.alias("v"))

    a, b = F.col(left), F.col(right)
    now = materialise(
        points(edges.where(a.isNotNull() & b.isNotNull() & (a != b)), F.greatest(a, b), F.least(a, b)).distinct())
    u, v = F.col("u"), F.col("v")
    known = None
    while True:
        both = now.unionByName(points(now, v, u))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        # a node without larger neighbours keeps its own edge to the smallest
        large = large.unionByName(points(now, u, v)).where(u != v).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).where(u != v)
        now = materialise(small.distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == known:
            break
        known = seen
    # every node now has one edge, to the smallest node of its component
    return now.select(u.alias("node"), v.alias("component")).unionByName(
        now.select(v.alias("node"), v.alias("component")).distinct())
