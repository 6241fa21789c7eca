"""Graph algorithms as iterated DataFrame jobs: shortest paths, acyclicity, topological order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.sources.shared import publish


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, allowed: DataFrame | None = None, max_hops: int = 100_000) -> DataFrame:
    """(src, dst, path) with one shortest path for each pair that has one.

    ``edges``: _src, _dst; ``sources``, ``targets``: _id; ``allowed``: _id of the nodes that a path may visit besides its
    source. Breadth first, level by level; each (source, node) is reached once, at its least distance, by its least parent,
    and levels hold parent pointers only. Paths are rebuilt backwards for the pairs asked for.
    """
    hops = edges.select("_src", "_dst").distinct()
    if allowed is not None:
        hops = hops.join(allowed.select(F.col("_id").alias("_dst")), "_dst", "left_semi").select("_src", "_dst")
    goals = targets.select(F.col("_id").alias("dst")).distinct()
    level = publish(sources.select(F.col("_id").alias("src"), F.col("_id").alias("node"), F.lit(None).cast(edges.schema["_src"].dataType).alias("parent"), F.lit(0).alias("dist")).distinct(), "bfs")
    visited = level
    k = 0
    wanted = goals.count() * level.count()
    while k < max_hops:
        k += 1
        found = level.join(hops, F.col("node") == F.col("_src")).groupBy("src", F.col("_dst").alias("node")).agg(F.min("_src").alias("parent")).withColumn("dist", F.lit(k))
        level = publish(found.join(visited.select("src", "node"), ["src", "node"], "left_anti"), "bfs")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
        if k % 8 == 0:
            visited = publish(visited, "bfs")
        if visited.join(goals, F.col("node") == F.col("dst"), "left_semi").count() >= wanted:
            break
    ends = visited.join(goals, F.col("node") == F.col("dst")).select("src", "dst", F.col("node").alias("at"), "parent", "dist", F.array("node").alias("path"))
    done = ends.where("dist = 0").select("src", "dst", "path")
    open_ = publish(ends.where("dist > 0"), "bfs")
    while not open_.isEmpty():
        step = open_.select("src", "dst", F.col("parent").alias("at"), F.array_prepend("path", F.col("parent")).alias("path"))
        back = visited.select(F.col("src").alias("s2"), F.col("node").alias("n2"), "parent", "dist")
        step = publish(step.join(back, (F.col("src") == F.col("s2")) & (F.col("at") == F.col("n2"))).select("src", "dst", "at", "parent", "dist", "path"), "bfs")
        done = done.unionByName(step.where("dist = 0").select("src", "dst", "path"))
        open_ = step.where("dist > 0")
    return done


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """(_id, level) of all nodes that repeated removal of nodes without incoming edges reaches, and whether it reaches all."""
    left_nodes = publish(nodes.select("_id").distinct(), "peel")
    ids = left_nodes.select(F.col("_id").alias("x"))
    left = edges.select("_src", "_dst").join(ids, F.col("_src") == F.col("x"), "left_semi").join(ids, F.col("_dst") == F.col("x"), "left_semi")
    left = publish(left, "peel")
    out: DataFrame | None = None
    level = 0
    while True:
        free = publish(left_nodes.join(left.select(F.col("_dst").alias("_id")).distinct(), "_id", "left_anti").withColumn("level", F.lit(level)), "peel")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        gone = free.select("_id")
        left_nodes = publish(left_nodes.join(gone, "_id", "left_anti"), "peel")
        left = publish(left.join(gone, F.col("_src") == F.col("_id"), "left_anti"), "peel")
        level += 1
    return (out if out is not None else left_nodes.withColumn("level", F.lit(0)).limit(0)), left_nodes.isEmpty()
