"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node it reaches.

    Each step keeps, for a node, edges to the least neighbour only, so a hub's edges are combined before a shuffle and the
    edge list never grows; the number of rounds is logarithmic in the longest path. Rounds end in the shared folder, where
    each replaces the one before.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables of their own, so that a hub's edges meet its least neighbour in a join that can be split
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after_edges = scratch.keep(small, "edges")
        scratch.drop(edges, least, large)
        edges = after_edges
        after = _state(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
