"""Connected components by alternating large-star and small-star steps; every step is an aggregation and a join on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, settle


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "w")), F.sum(F.col("w").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, comp`` for every node of ``edges`` (long columns ``a``, ``b``); ``comp`` is the smallest node reachable.

    The state is written out after every round, which cuts lineage. A round ends when all edges point to the smallest node.
    """
    ends = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
    state = settle(ends.distinct())
    before = _signature(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("w") > F.col("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(low, "u").where(F.col("w") != F.col("m")).select(F.col("w").alias("u"), F.col("m").alias("w"))
        old, state = state, settle(small.unionByName(low.select("u", F.col("m").alias("w"))).distinct())
        release(old)
        after = _signature(state)
        if after == before:
            break
        before = after
    roots = state.select(F.col("w").alias("v")).distinct().select("v", F.col("v").alias("comp"))
    return roots.unionByName(state.select(F.col("u").alias("v"), F.col("w").alias("comp")))


def joined_components(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` after further ``edges``: only the components that these join are searched, as nodes of their smallest members."""
    for end in ("a", "b"):
        home = comps.select(F.col("v").alias(end), F.col("comp").alias("_comp"))
        edges = edges.join(home, end, "left").withColumn(end, F.coalesce("_comp", end)).drop("_comp")
    joined = connected_components(edges)
    moved = comps.join(joined.select(F.col("v").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    fresh = joined.join(comps.select("v"), "v", "left_anti")
    return moved.select("v", F.coalesce("to", "comp").alias("comp")).unionByName(fresh.select("v", "comp"))
