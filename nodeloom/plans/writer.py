"""Statements that write: each clause reads the rows so far and turns the snapshot into the next one."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.errors import CypherRuntimeError, CypherSemanticError, NodeHasEdgesError
from nodeloom.functions.expressions import Edge, Node, Val, kind
from nodeloom.operators.mutations import Add, Change, DropLabels, Remove, Snapshot, Update
from nodeloom.plans import syntax as s
from nodeloom.plans.compiler import Compiler, Rows
from nodeloom.sources.shared import publish


@dataclass
class Summary:
    nodes_created: int = 0
    edges_created: int = 0
    nodes_deleted: int = 0
    edges_deleted: int = 0
    properties_set: int = 0
    labels_removed: int = 0
    indexes_created: int = 0
    indexes_deleted: int = 0

    def as_dict(self) -> dict[str, int]:
        return dict(self.__dict__)


@dataclass
class Outcome:
    df: DataFrame | None
    snapshot: Snapshot
    changes: list[Change] = field(default_factory=list)
    summary: Summary = field(default_factory=Summary)


class Writer:
    def __init__(self, spark: SparkSession, snapshot: Snapshot, params: dict[str, Any] | None = None) -> None:
        self.spark, self.params = spark, params or {}
        self.out = Outcome(None, snapshot)
        self.now = int(time.time() * 1000)
        self.gone: set[str] = set()
        self.c = Compiler(spark, snapshot.catalog(), self.params)

    def run(self, q: s.Query) -> Outcome:
        rows = self.c.unit()
        self.c.read = self.c._reads(q)
        for segment in q.segments:
            rows = self.c.reading(rows, segment.reading)
            for clause in segment.writing:
                rows = {s.Create: self.create, s.Merge: self.merge, s.Set: self.set, s.Delete: self.delete, s.Remove: self.remove}[type(clause)](rows, clause)
            if segment.projection is not None:
                rows = self.c.project(rows, segment.projection, final=segment is q.segments[-1])
        last = q.segments[-1].projection
        self.out.df = rows.df if last is not None else self.spark.createDataFrame([], "")
        return self.out

    def _apply(self, change: Change) -> None:
        self.out.changes.append(change)
        self.out.snapshot = change.apply(self.out.snapshot).settled()
        self.c.catalog = self.out.snapshot.catalog()

    def _frozen(self, rows: Rows, df: DataFrame) -> Rows:
        return Rows(publish(df, "rows"), rows.scope)

    # ---------------------------------------------------------------- CREATE

    def create(self, rows: Rows, c: s.Create) -> Rows:
        names: set[str] = set()
        for p in c.paths:
            for n in s.pattern_names(p):
                if n in names and any(e.name == n for e in p.edges):
                    raise CypherSemanticError(f"Variable '{n}' is already defined")
                names.add(n)
            for e in p.edges:
                if e.variable or len(e.types) != 1:
                    raise CypherSemanticError("CREATE needs relationships of one type and one hop")
        return self._make(rows, c.paths)

    def _constants(self, props: tuple[tuple[str, s.Expr], ...]) -> dict[str, Val]:
        out = {k: self.c.exprs.value(v, {}) for k, v in props}
        for k, v in out.items():
            if kind(v.type) in ("list", "object"):
                raise CypherRuntimeError(f"Property '{k}' must be a string, number, boolean or null")
        return {k: v for k, v in out.items() if v.type is not None}

    def _make(self, rows: Rows, paths: list[s.Path] | tuple[s.Path, ...]) -> Rows:
        """Creates the parts of ``paths`` that are not bound, once per row."""
        scope = dict(rows.scope)
        df = self.c._frame(rows)
        new_nodes: list[tuple[Node, dict[str, Val], tuple[str, ...]]] = []
        new_edges: list[tuple[Edge, dict[str, Val], str]] = []
        cols: dict[str, Column] = {}
        for p in paths:
            ends: list[Node] = []
            for n in p.nodes:
                b = scope.get(n.name) if n.name else None
                if b is not None:
                    if not isinstance(b, Node):
                        raise CypherSemanticError(f"Variable '{n.name}' is not a node")
                    if n.labels or n.props:
                        raise CypherSemanticError(f"Variable '{n.name}' is already defined")
                    ends.append(b)
                    continue
                base = self.c._name(n.name or "n")
                props = self._constants(n.props)
                node = Node(f"{base}_id", "", f"{base}_labels", {k: (f"{base}_{j}", v.type) for j, (k, v) in enumerate(props.items())}, {"createdOn": f"{base}_c", "updatedOn": f"{base}_u"})
                cols |= {node.id: F.uuid(), node.labels or "": F.array(*[F.lit(x) for x in n.labels]).cast("array<string>"), f"{base}_c": F.lit(self.now).cast("long"), f"{base}_u": F.lit(self.now).cast("long")}
                cols |= {node.props[k][0]: v.col for k, v in props.items()}
                new_nodes.append((node, props, n.labels))
                ends.append(node)
                if n.name:
                    scope[n.name] = node
            for k, e in enumerate(p.edges):
                a, z = (ends[k + 1], ends[k]) if e.incoming else (ends[k], ends[k + 1])
                base = self.c._name(e.name or "r")
                props = self._constants(e.props)
                edge = Edge(f"{base}_id", f"{base}_src", f"{base}_dst", "", "", f"{base}_type", {k2: (f"{base}_{j}", v.type) for j, (k2, v) in enumerate(props.items())}, {"createdOn": f"{base}_c", "updatedOn": f"{base}_u"})
                cols |= {edge.id: F.uuid(), edge.type: F.lit(e.types[0]), f"{base}_c": F.lit(self.now).cast("long"), f"{base}_u": F.lit(self.now).cast("long"), edge.src: ("ref", a.id), edge.dst: ("ref", z.id)}  # type: ignore[dict-item]
                cols |= {edge.props[k2][0]: v.col for k2, v in props.items()}
                new_edges.append((edge, props, e.types[0]))
                if e.name:
                    scope[e.name] = edge
        refs = {k: v[1] for k, v in cols.items() if isinstance(v, tuple)}
        df = df.withColumns({k: v for k, v in cols.items() if not isinstance(v, tuple)})
        df = df.withColumns({k: F.col(v) for k, v in refs.items()}) if refs else df
        rows = self._frozen(Rows(df, scope), df)
        df = rows.df
        assert df is not None
        n = df.count() if new_nodes or new_edges else 0
        for node, props, _ in new_nodes:
            self._apply(Add("node", df.select(F.col(node.id).alias("_id"), F.col(node.labels).alias("_labels"), *[F.col(c).alias(m) for m, c in node.meta.items()], *[F.col(node.props[k][0]).alias(k) for k in props])))
        for edge, props, _ in new_edges:
            self._apply(Add("edge", df.select(F.col(edge.id).alias("_id"), F.col(edge.src).alias("_src"), F.col(edge.dst).alias("_dst"), F.col(edge.type).alias("_type"), *[F.col(c).alias(m) for m, c in edge.meta.items()], *[F.col(edge.props[k][0]).alias(k) for k in props])))
        self.out.summary.nodes_created += n * len(new_nodes)
        self.out.summary.edges_created += n * len(new_edges)
        self.out.summary.properties_set += n * sum(len(x[1]) for x in (*new_nodes, *new_edges))
        return rows

    # ---------------------------------------------------------------- MERGE

    def merge(self, rows: Rows, m: s.Merge) -> Rows:
        """Rows whose pattern exists keep their matches; for the others the missing parts are made once per distinct set of
        bound ends, which is what handling rows one by one would leave."""
        p = m.path
        if any(e.variable for e in p.edges):
            raise CypherSemanticError("MERGE cannot have relationships of variable length")
        mark = self.c._name("row")
        df = self._frozen(rows, self.c._frame(rows).withColumn(mark, F.monotonically_increasing_id())).df
        assert df is not None
        pattern = s.Path(p.name, tuple(s.NodePattern(n.name, *((), ()) if n.name in rows.scope else (n.labels, n.props)) for n in p.nodes), p.edges)
        start = Rows(df, rows.scope)
        saved, self.c.read = self.c.read, self.c.read | set(s.pattern_names(p))
        matched = self.c.match(start, [pattern], None)
        matched = self._frozen(matched, self.c._frame(matched))
        hit = matched.df.select(F.col(mark).alias("__m")).distinct()  # type: ignore[union-attr]
        missing = publish(df.join(hit, F.col(mark) == F.col("__m"), "left_anti"), "rows")
        if m.on_match:
            matched = self._set_items(matched, m.on_match)
        if missing.isEmpty():
            self.c.read = saved
            return matched
        bound = [rows.scope[n.name] for n in p.nodes if n.name and n.name in rows.scope]
        keys = [b.id for b in bound]  # type: ignore[union-attr]
        first = missing.dropDuplicates(keys) if keys else missing.limit(1)
        made = self._make(Rows(first, rows.scope), [pattern])
        if m.on_create:
            made = self._set_items(made, m.on_create)
        # every missing row now finds what was made for its ends
        again = self.c.match(Rows(missing, rows.scope), [pattern], None)
        self.c.read = saved
        if matched.df.isEmpty():  # type: ignore[union-attr]
            return self._frozen(again, self.c._frame(again))
        both = self.c.match(Rows(df, rows.scope), [pattern], None)
        return self._frozen(both, self.c._frame(both))

    # ---------------------------------------------------------------- SET, REMOVE

    def set(self, rows: Rows, c: s.Set) -> Rows:
        return self._set_items(rows, c.items)

    def _target(self, rows: Rows, name: str) -> tuple[Node | Edge, str]:
        b = rows.scope.get(name)
        if name in self.gone:
            raise CypherSemanticError(f"Variable '{name}' has been deleted")
        if not isinstance(b, (Node, Edge)):
            raise CypherSemanticError(f"Variable '{name}' is not a node or relationship")
        return b, "node" if isinstance(b, Node) else "edge"

    def _ids(self, df: DataFrame, b: Node | Edge) -> Column:
        return F.col(b.id).cast("string")

    def _set_items(self, rows: Rows, items: list[s.SetItem]) -> Rows:
        rows = self._frozen(rows, self.c._frame(rows))
        for i in items:
            b, what = self._target(rows, i.target)
            reset = False
            if i.key:
                if isinstance(i.value, (s.ListOf, s.MapOf)):
                    raise CypherSemanticError(f"Property '{i.key}' must be a string, number, boolean or null")
                rows, e = self.c.extract(rows, i.value)
                values = {i.key: self.c.exprs.value(e, rows.scope)}
            else:
                value = i.value
                if isinstance(value, s.Param):
                    held = self.params.get(value.name)
                    if not isinstance(held, dict):
                        raise CypherRuntimeError("SET needs a map")
                    value = s.MapOf(tuple((k, s.Lit(v)) for k, v in held.items()))
                if not isinstance(value, s.MapOf):
                    raise CypherSemanticError("SET needs a map")
                values = {k: self.c.exprs.value(v, rows.scope) for k, v in value.entries}
                reset = i.op == "="
            for k, v in values.items():
                if kind(v.type) in ("list", "object", "entity", "path"):
                    raise CypherRuntimeError(f"Property '{k}' must be a string, number, boolean or null")
            df = self.c._frame(rows).where(F.col(b.id).isNotNull())
            upd = df.select(self._ids(df, b).alias("_id"), *[(v.col if v.type is not None else F.lit(None).cast(self._type_of(what, k))).alias(k) for k, v in values.items()])
            upd = publish(upd.dropDuplicates(["_id"]), "set")
            self._apply(Update(what, upd, reset))
            self.out.summary.properties_set += upd.count() * max(1, len(values))
            rows = self._refresh(rows)
        return rows

    def _type_of(self, what: str, key: str) -> T.DataType:
        df = self.out.snapshot.nodes if what == "node" else self.out.snapshot.edges
        return df.schema[key].dataType if key in df.columns else T.StringType()

    def _refresh(self, rows: Rows) -> Rows:
        """Bound nodes and edges with their present values."""
        df, scope = self.c._frame(rows), dict(rows.scope)
        for name, b in rows.scope.items():
            if isinstance(b, Node):
                found, new = self.c.nodes((), name)
                df = df.join(found, F.col(b.id) == F.col(new.id), "left")
                scope[name] = new
            elif isinstance(b, Edge):
                found, new_edge, _ = self.c.edges(s.EdgePattern(None, (), (), False), name, Node("x", "", None, {}), None)
                assert found is not None
                df = df.join(found, F.col(b.id).cast("string") == F.col(new_edge.id), "left")
                scope[name] = new_edge
        return self._frozen(Rows(df, scope), df)

    def remove(self, rows: Rows, c: s.Remove) -> Rows:
        rows = self._frozen(rows, self.c._frame(rows))
        for name, key, labels in c.items:
            b, what = self._target(rows, name)
            df = self.c._frame(rows).where(F.col(b.id).isNotNull())
            ids = publish(df.select(self._ids(df, b).alias("_id")).distinct(), "ids")
            if key:
                self._apply(Update(what, ids.withColumn(key, F.lit(None).cast(self._type_of(what, key)))))
                self.out.summary.properties_set += ids.count()
            else:
                if what != "node":
                    raise CypherSemanticError("Only a node has labels to remove")
                have = self.out.snapshot.nodes.join(ids, "_id", "left_semi").select(F.sum(F.size(F.array_intersect("_labels", F.array(*[F.lit(x) for x in labels])))).alias("n")).first()["n"]
                self._apply(DropLabels(ids, labels))
                self.out.summary.labels_removed += have or 0
            rows = self._refresh(rows)
        return rows

    # ---------------------------------------------------------------- DELETE

    def delete(self, rows: Rows, c: s.Delete) -> Rows:
        rows = self._frozen(rows, self.c._frame(rows))
        targets = [(n, *self._target(rows, n)) for n in c.names]
        for pick in ("edge", "node"):
            for name, b, what in targets:
                if what != pick:
                    continue
                df = self.c._frame(rows).where(F.col(b.id).isNotNull())
                ids = publish(df.select(self._ids(df, b).alias("_id")).distinct(), "ids")
                n = ids.count()
                if what == "node":
                    snap = self.out.snapshot
                    # by either end in turn: "this end or that one" would compare every edge with every id
                    begun = snap.edges.select("_src", "_dst").join(ids, F.col("_src") == F.col("_id"), "left").withColumnRenamed("_id", "__src")
                    touching = begun.join(ids, F.col("_dst") == F.col("_id"), "left").where(F.col("__src").isNotNull() | F.col("_id").isNotNull()).count()
                    if touching and not c.detach:
                        raise NodeHasEdgesError(f"Cannot delete nodes of '{name}': {touching} edges are attached")
                    self.out.summary.edges_deleted += touching
                    self.out.summary.nodes_deleted += n
                else:
                    self.out.summary.edges_deleted += n
                self._apply(Remove(what, ids))
                self.gone.add(name)
        return rows
