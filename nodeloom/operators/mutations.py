"""Changes to a graph of one node table and one edge table, as functions from snapshot to snapshot.

What a change takes in (new rows, new values, ids) is published before the change exists, so it can be applied to any
snapshot, again after a concurrent commit too, always with the same outcome.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.sources.catalog import EDGE_META, NODE_META, Catalog, EdgeTable, NodeTable, quoted
from nodeloom.sources.shared import publish

NODE_SCHEMA = "_id string, _labels array<string>, createdOn long, updatedOn long"
EDGE_SCHEMA = "_id string, _src string, _dst string, _type string, createdOn long, updatedOn long"


@dataclass(frozen=True)
class Snapshot:
    nodes: DataFrame
    edges: DataFrame
    depth: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Snapshot:
        return cls(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    def catalog(self) -> Catalog:
        return Catalog((NodeTable(self.nodes, None),), (EdgeTable(self.edges, None),))

    def settled(self, most: int = 6) -> Snapshot:
        """Published once enough changes are stacked up."""
        if self.depth < most:
            return self
        return Snapshot(publish(self.nodes), publish(self.edges))


def _widest(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(a, (T.ArrayType, T.MapType, T.StructType)):
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """Union by name; a property of two types becomes a double if both are numbers, else a string."""
    for f in more.schema:
        if f.name in df.columns and not isinstance(f.dataType, T.ArrayType):
            t = _widest(df.schema[f.name].dataType, f.dataType)
            if df.schema[f.name].dataType != t:
                df = df.withColumn(f.name, F.col(quoted(f.name)).cast(t))
            if f.dataType != t:
                more = more.withColumn(f.name, F.col(quoted(f.name)).cast(t))
    return df.unionByName(more, allowMissingColumns=True)


@dataclass(frozen=True)
class Change:
    def apply(self, s: Snapshot) -> Snapshot:
        raise NotImplementedError

    def touched(self) -> DataFrame:
        """(kind, id, key) of what changes; key '*' stands for the whole entity."""
        raise NotImplementedError


def _marks(df: DataFrame, kind: str, ident: str = "_id", key: str = "*") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), F.lit(key).alias("key"))


@dataclass(frozen=True)
class Add(Change):
    kind: str
    rows: DataFrame

    def apply(self, s: Snapshot) -> Snapshot:
        if self.kind == "node":
            return replace(s, nodes=append(s.nodes, self.rows), depth=s.depth + 1)
        return replace(s, edges=append(s.edges, self.rows), depth=s.depth + 1)

    def touched(self) -> DataFrame:
        return _marks(self.rows, self.kind)


@dataclass(frozen=True)
class Update(Change):
    """``rows``: _id and new values; a column is written for every row. ``reset``: all other properties are cleared."""

    kind: str
    rows: DataFrame
    reset: bool = False

    def apply(self, s: Snapshot) -> Snapshot:
        df = s.nodes if self.kind == "node" else s.edges
        keys = [c for c in self.rows.columns if c != "_id"]
        upd = self.rows.select(F.col("_id").alias("__id"), *[F.col(quoted(k)).alias(f"__{k}") for k in keys], F.lit(True).alias("__hit"))
        meta = NODE_META if self.kind == "node" else EDGE_META
        joined = df.join(upd, F.col("_id") == F.col("__id"), "left")
        out = []
        for f in df.schema:
            c = F.col(quoted(f.name))
            if f.name in keys:
                t = _widest(f.dataType, self.rows.schema[f.name].dataType) if not isinstance(self.rows.schema[f.name].dataType, T.NullType) else f.dataType
                out.append(F.when(F.col("__hit"), F.col(quoted(f"__{f.name}")).cast(t)).otherwise(c.cast(t)).alias(f.name))
            elif self.reset and f.name not in meta:
                out.append(F.when(F.col("__hit").isNull(), c).alias(f.name))
            else:
                out.append(c)
        out += [F.col(quoted(f"__{k}")).alias(k) for k in keys if k not in df.columns]
        df = joined.select(*out)
        return replace(s, nodes=df, depth=s.depth + 1) if self.kind == "node" else replace(s, edges=df, depth=s.depth + 1)

    def touched(self) -> DataFrame:
        keys = ["*"] if self.reset else [c for c in self.rows.columns if c != "_id"] or ["*"]
        return reduce(DataFrame.union, [_marks(self.rows, self.kind, key=k) for k in keys])


@dataclass(frozen=True)
class DropLabels(Change):
    ids: DataFrame
    labels: tuple[str, ...]

    def apply(self, s: Snapshot) -> Snapshot:
        ids = self.ids.select(F.col("_id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
        gone = F.array(*[F.lit(x) for x in self.labels])
        df = s.nodes.join(ids, F.col("_id") == F.col("__id"), "left").withColumn("_labels", F.when(F.col("__hit"), F.array_except("_labels", gone)).otherwise(F.col("_labels"))).drop("__id", "__hit")
        return replace(s, nodes=df.select(*s.nodes.columns), depth=s.depth + 1)

    def touched(self) -> DataFrame:
        return _marks(self.ids, "node", key=":labels")


@dataclass(frozen=True)
class Remove(Change):
    """Nodes with all their edges, or edges."""

    kind: str
    ids: DataFrame

    def apply(self, s: Snapshot) -> Snapshot:
        ids = self.ids.select(F.col("_id").alias("__id")).distinct()
        if self.kind == "edge":
            return replace(s, edges=s.edges.join(ids, F.col("_id") == F.col("__id"), "left_anti"), depth=s.depth + 1)
        edges = s.edges.join(ids, F.col("_src") == F.col("__id"), "left_anti").join(ids, F.col("_dst") == F.col("__id"), "left_anti")
        return replace(s, nodes=s.nodes.join(ids, F.col("_id") == F.col("__id"), "left_anti"), edges=edges, depth=s.depth + 1)

    def touched(self) -> DataFrame:
        return _marks(self.ids, self.kind)


def conflicts(a: list[Change], b: list[Change]) -> bool:
    """Do two lists of changes touch the same property of an entity, or one its whole and the other anything of it?"""
    if not a or not b:
        return False
    x = reduce(DataFrame.union, [c.touched() for c in a])
    y = reduce(DataFrame.union, [c.touched() for c in b]).select(F.col("kind").alias("kind2"), F.col("id").alias("id2"), F.col("key").alias("key2"))
    same = (F.col("kind") == F.col("kind2")) & (F.col("id") == F.col("id2")) & ((F.col("key") == F.col("key2")) | (F.col("key") == "*") | (F.col("key2") == "*"))
    return not x.join(y, same, "left_semi").isEmpty()
