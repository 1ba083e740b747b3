"""Connected components of a graph of long ids, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize

#: Parts that a node's neighbours are dealt to, at most, so that a hub isn't one task.
PARTS = 1024


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) for every node of the pairs (u, v): the smallest node reachable.

    Alternates the two star steps of Kiveris et al. ("Connected Components in MapReduce and Beyond"):
    hang a node's larger neighbours on its smallest one, then its smaller ones likewise.  The number of
    edges never grows, a hub's neighbours are joined with its minimum in parts and never gathered, and each
    round is written to the shared folder.  Pairs with a null or of a node with itself are ignored.
    """
    lo, hi = F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")
    e = materialize(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(lo, hi).distinct())
    state = None
    while (now := _state(e)) != state:
        state = now
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        # large star: u's larger neighbours go to the smallest of u and its neighbours
        large = _with_least(both, "u", "v").where("v > u").select(F.least("u", "m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small star: u's smaller neighbours, and u, go to the smallest of them
        small = _with_least(large, "hi", "lo").select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        after = materialize(small.where("lo < hi").distinct())
        discard(e)
        e = after
    leaves = e.select(F.col("hi").alias("node"), F.col("lo").alias("component_id"))
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return leaves.unionByName(roots)


def _with_least(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """pairs with m, the least `other` of each node; a node's rows are dealt to parts, of which it has no more than rows."""
    x = pairs.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(PARTS)))
    parts = x.groupBy(node, "_part").agg(F.min(other).alias("m"))
    least = parts.groupBy(node).agg(F.min("m").alias("m"))
    return x.join(parts.select(node, "_part").join(least, node), [node, "_part"]).drop("_part")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi")), F.sum(F.shiftright(F.xxhash64("hi", "lo"), 24))).first())
