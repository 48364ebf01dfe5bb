"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Nulls and self loops carry no link and are left out, so a node that has only those is absent from the result, and
    an empty edge list gives an empty result. Each round only groups with map-side minima and joins on the node; a hub
    is not gathered anywhere, and a skewed join is split at run time. Rounds grow with the logarithm of the longest
    path. Lineage is cut by a checkpoint in each round, so a lost executor repeats one round at most.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("_s"), F.col(dst).alias("_d"))
    e = checkpointed(e.where(F.col("_s").isNotNull() & F.col("_d").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct())
    before = _state(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
