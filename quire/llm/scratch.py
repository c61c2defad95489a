"""Connected components by tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.storage import Scratch

__all__ = ["Scratch", "connected_components"]


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node that has an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds: the number of rounds is logarithmic in practice,
    each is two aggregations and two equi-joins, and no node's neighbours are ever gathered.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = scratch.keep(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        mark = tuple(seen)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        after = scratch.keep(small, "small")
        scratch.drop(now, large)
        now = after
