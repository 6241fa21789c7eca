"""Paths of variable length: all trails (no edge twice) by iterated joins."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.expressions import Edge, Node
from nodeloom.plans import syntax as s
from nodeloom.sources.catalog import global_id
from nodeloom.sources.shared import publish

if TYPE_CHECKING:
    from nodeloom.plans.compiler import Compiler

#: Trails up to this length are one lazy plan; longer ones publish each level, so that no level is computed twice.
LAZY = 3


def trails(c: Compiler, df: DataFrame, near: Node, edges: DataFrame, edge: Edge, e: s.EdgePattern, named: bool, backwards: bool) -> tuple[DataFrame, Column, Column]:
    """Rows joined with every trail from ``near``: the end in ``<edge id>_cur``, the edge's columns those of the last edge.

    Also, for named paths, the trail's edges and the nodes between its ends, in pattern order.
    """
    cur, used, rels, mids = (f"{edge.id}_{x}" for x in ("cur", "used", "rels", "mids"))
    here, there = (edge.dst, edge.src) if e.incoming else (edge.src, edge.dst)
    spaces = (edge.dst_space, edge.src_space) if e.incoming else (edge.src_space, edge.dst_space)
    # ids stay native if one space holds all nodes of the trail
    native = spaces[0] == spaces[1] == near.space and near.space is not None
    ident = (lambda col, space: col) if native else global_id
    rel_struct = F.struct(edge.identity().alias("id"), global_id(F.col(edge.src), edge.src_space).alias("sourceId"), global_id(F.col(edge.dst), edge.dst_space).alias("targetId"), F.col(edge.type).alias("type"), (F.create_map(*[x for k, (col, _) in sorted(edge.props.items()) for x in (F.lit(k), F.col(col).cast("string"))]) if edge.props else F.create_map().cast("map<string,string>")).alias("properties"))
    low, high = max(e.low or 1, 1), e.high
    base = df.withColumn(cur, ident(F.col(near.id), near.space)).withColumn(used, F.array().cast("array<string>"))
    if named:
        base = base.withColumn(rels, F.array().cast("array<struct<id:string,sourceId:string,targetId:string,type:string,properties:map<string,string>>>")).withColumn(mids, F.array().cast("array<string>"))
    own = [edge.id, edge.src, edge.dst, edge.type, *(col for col, _ in edge.props.values()), *edge.meta.values()]
    keep = base.columns
    found: list[DataFrame] = []
    level = base
    k = 0
    while high is None or k < high:
        k += 1
        frontier = level.select(*keep)
        step = frontier.join(edges, F.col(cur) == ident(F.col(here), spaces[0])).where(~F.array_contains(used, F.col(edge.id).cast("string")))
        changes = {cur: ident(F.col(there), spaces[1]), used: F.array_append(used, F.col(edge.id).cast("string"))}
        if named:
            changes |= {rels: F.array_append(rels, rel_struct) if not backwards else F.array_prepend(rels, rel_struct)}
            if k > 1:
                at = F.col(cur).cast("string")
                changes |= {mids: F.array_append(mids, at) if not backwards else F.array_prepend(mids, at)}
        level = step.withColumns(changes).select(*keep, *own)
        if high is None or high > LAZY:
            level = publish(level, "trail")
            if level.isEmpty():
                break
        if k >= low:
            found.append(level)
    out = reduce(DataFrame.unionByName, found) if found else level.where(F.lit(False)) if k else base.crossJoin(edges).where(F.lit(False))
    if not named:
        return out.drop(used), F.array(), F.array()
    if c.lean:  # every node exists and only their number is read: ids will do
        body = "struct<id:string,labels:array<string>,properties:map<string,string>>"
        return out.drop(used), F.col(rels), F.transform(mids, lambda x: F.struct(x.alias("id"), F.array().cast("array<string>").alias("labels"), F.create_map().cast("map<string,string>").alias("properties")).cast(body))
    # a node between two edges is at both their ends, so it is in the space of the edges' sources
    nodes, b = c.nodes((), "mid", edge.src_space)
    key = f"{edge.id}_row"
    props = F.create_map(*[x for p, (col, _) in sorted(b.props.items()) for x in (F.lit(p), F.col(col).cast("string"))]) if b.props else F.create_map().cast("map<string,string>")
    plain = nodes.select(global_id(F.col(b.id), b.space).alias("_mid"), F.struct(global_id(F.col(b.id), b.space).alias("id"), F.col(b.labels).alias("labels"), props.alias("properties")).alias("_node"))
    marks = out.select(mids).distinct().withColumn(key, F.col(mids))
    filled = marks.select(key, F.posexplode(mids).alias("_pos", "_id")).join(plain, F.col("_id") == F.col("_mid") if native is False or near.space in ("", None) else F.concat(F.lit(f"{near.space}:"), F.col("_id")) == F.col("_mid")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_node")), lambda x, y: x["_pos"] - y["_pos"]), lambda x: x["_node"]).alias(f"{mids}_nodes"))
    out = out.join(filled, F.col(mids) == F.col(key), "left").drop(key)
    empty = F.array().cast("array<struct<id:string,labels:array<string>,properties:map<string,string>>>")
    return out.drop(used), F.col(rels), F.coalesce(F.col(f"{mids}_nodes"), empty)
