"""Queries to DataFrames.

A variable in scope is a set of flat columns (id, labels, one per property), so Catalyst prunes what a query does not
read and pushes filters into scans; whole entities become structs only where they leave the query. Patterns are
equi-joins on native keys; a pattern's end is looked up only if the query reads more of it than its id or its label is
in doubt. OPTIONAL MATCH, EXISTS and pattern comprehensions evaluate their pattern once for the distinct outer values
they depend on and join the outcome back (left, semi, anti, mark or grouped), which needs no row ids.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.errors import CypherRuntimeError, CypherSemanticError, UnboundParameterError
from nodeloom.functions.expressions import BOOL, LONG, STR, Binding, Edge, Expressions, Node, Scope, Val, column, entity_value, is_num, is_str, kind, null, truth
from nodeloom.operators.traversal import trails
from nodeloom.plans import ordering
from nodeloom.plans import syntax as s
from nodeloom.plans.parser import alias_of, has_aggregate, is_aggregate
from nodeloom.plans.products import counted
from nodeloom.sources.catalog import EDGE_META, Catalog, EdgeTable, NodeTable, global_id

_UNIT = "_unit"


def conjuncts(e: s.Expr | None) -> list[s.Expr]:
    if e is None:
        return []
    if isinstance(e, s.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def as_predicate(e: Any) -> Any:
    """Bare patterns where a truth value stands mean that the pattern exists."""
    if isinstance(e, s.PatternExpr):
        return s.Exists((e.path,), None)
    if isinstance(e, s.Binary) and e.op in ("AND", "OR", "XOR"):
        return s.Binary(e.op, as_predicate(e.left), as_predicate(e.right))
    if isinstance(e, s.Unary) and e.op == "NOT":
        return s.Unary("NOT", as_predicate(e.of))
    return e


def names_read(x: Any) -> set[str]:
    """Variables of which an expression reads more than the id."""
    if isinstance(x, s.Var):
        return {x.name}
    if isinstance(x, s.Call) and x.name.lower() in ("id", "count") and len(x.args) == 1 and isinstance(x.args[0], s.Var):
        return set()
    return {n for y in s.children(x) for n in names_read(y)}


class Rows:
    """A DataFrame and what its columns mean."""

    def __init__(self, df: DataFrame | None, scope: Scope) -> None:
        self.df, self.scope = df, scope


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, params: dict[str, Any] | None = None) -> None:
        self.spark, self.catalog, self.params = spark, catalog, params or {}
        self.exprs = Expressions(self.params)
        self.fresh = count()
        self.read: set[str] = set()
        #: For PROFILE: (kind of step, rows so far) of the outermost pattern, as :func:`describe.steps` names them.
        self.trace: list[tuple[str, DataFrame]] | None = None
        self.inside = 0
        #: Named paths of which a query reads only how many nodes they have, and relationships; is this path one of them?
        self.sized: set[str] = set()
        self.lean = False
        #: Column with how many rows of the pattern a row stands for, while counts over pairs are projected.
        self.weight: str | None = None
        #: Edge tables that a path has begun with, by the column of the node begun at.
        self.opened: dict[str, tuple[DataFrame | None, Edge, list[EdgeTable]]] = {}

    # ---------------------------------------------------------------- entry

    def union(self, q: s.Union) -> DataFrame:
        frames = [self.query(x) for x in q.queries]
        names = [f.columns for f in frames]
        for k, other in enumerate(names[1:], 2):
            if len(other) != len(names[0]):
                raise CypherSemanticError(f"UNION parts differ in width: part 1 has {len(names[0])} columns, part {k} has {len(other)}")
            if other != names[0]:
                raise CypherSemanticError(f"All queries in a UNION must return the same column names: {names[0]} and {other}")
        out = frames[0]
        for frame, keep in zip(frames[1:], q.all, strict=True):
            out = out.unionByName(frame)
            out = out if keep else out.dropDuplicates()
        scope: Scope = {f.name: Val(column(f.name), f.dataType) for f in out.schema}
        for item in q.order:
            for x in s.walk(item.expr):
                if isinstance(x, s.Var) and x.name not in scope:
                    raise CypherSemanticError(f"UNION ORDER BY may only refer to returned columns, not '{x.name}'")
        if q.order:
            out = out.orderBy(*[self._sort(self.exprs.value(i.expr, scope).col, i.descending) for i in q.order])
        return self._cut(out, q.skip, q.limit)

    def query(self, q: s.Query) -> DataFrame:
        rows = self.unit()
        self.read = self._reads(q)
        for segment in q.segments:
            pairs = counted(self, segment) if rows.df is None and not rows.scope else None
            rows = pairs[0] if pairs else self.reading(rows, segment.reading)
            if segment.writing:
                raise CypherSemanticError("This query writes; run it through Graph.query")
            assert segment.projection is not None
            self.weight = pairs[1] if pairs else None
            rows = self.project(rows, segment.projection, final=segment is q.segments[-1])
            self.weight = None
        assert rows.df is not None
        return rows.df

    def _note(self, kind: str, rows: Rows) -> Rows:
        if self.trace is not None and not self.inside and rows.df is not None:
            self.trace.append((kind, rows.df))
        return rows

    def unit(self) -> Rows:
        return Rows(None, {})

    def _sized(self, q: s.Query) -> set[str]:
        """Named paths that a query reads only by size(nodes(p)) and relationships(p)."""
        paths = [p for g in q.segments for c in g.reading if isinstance(c, s.Match) for p in c.paths]
        other: set[str] = set()

        def look(x: Any) -> None:
            if isinstance(x, s.Call) and x.name.lower() == "size" and len(x.args) == 1 and isinstance(x.args[0], s.Call) and x.args[0].name.lower() == "nodes" and all(isinstance(y, s.Var) for y in x.args[0].args):
                return
            if isinstance(x, s.Call) and x.name.lower() == "relationships" and all(isinstance(y, s.Var) for y in x.args):
                return
            if isinstance(x, s.Var):
                other.add(x.name)
            for y in s.children(x):
                look(y)

        for g in q.segments:
            for c in g.reading:
                look(c.expr if isinstance(c, s.Unwind) else c.where)
            for i in (*g.projection.items, *g.projection.order) if g.projection else ():
                look(i.expr)
            look(g.projection.where if g.projection else None)
        for p in paths:
            for x in s.pattern_exprs(p):
                look(x)
        return {p.name for p in paths if p.name and p.name not in other}

    def _reads(self, q: s.Query) -> set[str]:
        self.sized = self._sized(q)
        out: set[str] = set()
        for g in q.segments:
            for c in g.reading:
                for e in ([c.expr] if isinstance(c, s.Unwind) else [c.where] if c.where else []):
                    out |= names_read(e)
            for w in g.writing:
                if isinstance(w, s.Set):
                    out |= {n for i in w.items for n in names_read(i.value)}
            if g.projection:
                for i in g.projection.items:
                    out |= names_read(i.expr) | ({i.expr.name} if isinstance(i.expr, s.Var) else set())
                for e in (*(o.expr for o in g.projection.order), *([g.projection.where] if g.projection.where else [])):
                    out |= names_read(e)
            if g.projection and g.projection.star or g.writing:
                self.sized = set()
                out |= {n for c in g.reading if isinstance(c, s.Match) for p in c.paths for n in s.pattern_names(p)}
        return out

    def _name(self, hint: str) -> str:
        return f"{''.join(ch if ch.isalnum() else '_' for ch in hint)}_{next(self.fresh)}"

    def _frame(self, rows: Rows) -> DataFrame:
        return rows.df if rows.df is not None else self.spark.range(1).select(F.lit(1).alias(_UNIT))

    # ---------------------------------------------------------------- reading clauses

    def reading(self, rows: Rows, clauses: list) -> Rows:
        k = 0
        while k < len(clauses):
            c = clauses[k]
            k += 1
            if isinstance(c, s.Unwind):
                rows = self._note("Unwind", self.unwind(rows, c))
            elif c.optional:
                rows = self._note("OptionalMatch", self.optional(rows, c))
            else:
                run = [c]
                while k < len(clauses) and isinstance(clauses[k], s.Match) and not clauses[k].optional:
                    run.append(clauses[k])
                    k += 1
                for m in run:
                    self._once(m.paths)
                ordered = self._ordered(rows, [p for m in run for p in m.paths])
                if ordered is not None:
                    for m in run:
                        ordered = self.where(ordered, m.where)
                    rows = ordered
                else:
                    for m in run:
                        rows = self.match(rows, m.paths, m.where)
        return rows

    def unwind(self, rows: Rows, c: s.Unwind) -> Rows:
        rows, e = self.extract(rows, c.expr)
        v = self.exprs.value(e, rows.scope)
        name = self._name(c.name)
        df = self._frame(rows)
        if v.type is None:
            return Rows(df.where(F.lit(False)).withColumn(name, v.col), rows.scope | {c.name: Val(F.col(name), None)})
        if not isinstance(v.type, T.ArrayType):
            return Rows(df.withColumn(name, v.col).where(F.col(name).isNotNull()), rows.scope | {c.name: Val(F.col(name), v.type)})
        return Rows(df.select("*", F.explode(v.col).alias(name)), rows.scope | {c.name: Val(F.col(name), v.type.elementType)})

    def _once(self, paths: Iterable[s.Path]) -> None:
        own: set[str] = set()
        for p in paths:
            for n in [*([p.name] if p.name else []), *s.pattern_names(p)]:
                if n in own:
                    raise CypherSemanticError(f"Variable '{n}' is bound more than once in one MATCH")
                own.add(n)

    def match(self, rows: Rows, paths: Iterable[s.Path], where: s.Expr | None) -> Rows:
        paths = list(paths)
        self._once(paths)
        for p in paths:
            rows = self.path(rows, p)
        return self.where(rows, where)

    def _ordered(self, rows: Rows, paths: list[s.Path]) -> Rows | None:
        """Patterns with a cycle, joined edge by edge in the order of :mod:`ordering`; None where the written order will do."""
        edges = [e for p in paths for e in p.edges]
        names = [x.name for p in paths for x in (*p.nodes, *p.edges) if x.name]
        kinds_differ = {n for p in paths for n in (x.name for x in p.nodes)} & {e.name for e in edges if e.name}
        if any(p.name or not p.edges for p in paths) or any(e.variable or e.name and (e.name in rows.scope or names.count(e.name) > 1) for e in edges) or kinds_differ:
            return None
        if any(isinstance(rows.scope.get(n.name), Edge | Val) for p in paths for n in p.nodes if n.name):
            return None
        single: list[tuple[s.NodePattern, s.EdgePattern, s.NodePattern]] = []
        for p in paths:
            nodes = [n if n.name else s.NodePattern(f" {next(self.fresh)}", n.labels, n.props) for n in p.nodes]
            for k, e in enumerate(p.edges):
                single.append((nodes[k], e, nodes[k + 1]))
        bound = {n for n, b in rows.scope.items() if isinstance(b, Node)}
        steps = [ordering.Step(a.name or "", b.name or "", *self._unique(e)) for a, e, b in single]
        if not ordering.has_cycle(steps, bound):
            return None
        start = list(dict.fromkeys(n.name or "" for a, _, b in single for n in (a, b)))
        labels: dict[str, set[str] | None] = {}
        hidden = {n for n in start if n.startswith(" ")}
        for begin, k in ordering.order(steps, bound, start):
            a, e, b = single[k]
            if begin == b.name or begin is None and a.name not in rows.scope or begin is None and b.name in rows.scope and not steps[k].from_a and steps[k].from_b:
                a, e, b = b, s.EdgePattern(e.name, e.types, e.props, not e.incoming, e.low, e.high), a
            rows, near = self._start_at_edge(rows, a, e) or self._start(rows, a)
            labels.setdefault(a.name or "", set(a.labels) or None)
            if begin is not None:
                self._note("NodeScan", rows)
            rows, far, _, _ = self._expand(rows, near, labels[a.name or ""], e, b, False, False)
            self._note("EdgeExpand", rows)
            if b.name not in rows.scope:
                rows = Rows(rows.df, rows.scope | {b.name or "": far})
            labels.setdefault(b.name or "", set(b.labels) or None)
        return Rows(rows.df, {n: b for n, b in rows.scope.items() if n not in hidden})

    def _unique(self, e: s.EdgePattern) -> tuple[bool, bool]:
        """Whether a node at the pattern's left, at its right, has one such edge at most."""
        tables = self.catalog.edge_tables(e.types)
        src, dst = (len(tables) == 1 and end in tables[0].unique for end in ("src", "dst"))
        return (dst, src) if e.incoming else (src, dst)

    def where(self, rows: Rows, where: s.Expr | None) -> Rows:
        if where is None:
            return rows
        if has_aggregate(where):
            raise CypherSemanticError("WHERE cannot hold an aggregate")
        for part in conjuncts(as_predicate(where)):
            negated = isinstance(part, s.Unary) and part.op == "NOT" and isinstance(part.of, s.Exists)
            if isinstance(part, s.Exists) or negated:
                rows = self.semi(rows, part.of if negated else part, negated)
                continue
            outer = rows.scope
            rows, e = self.extract(rows, part)
            rows = Rows(self._frame(rows).where(self.exprs.truth(e, rows.scope)), outer)
        return self._note("Filter", rows)

    # ---------------------------------------------------------------- patterns

    def nodes(self, labels: tuple[str, ...], hint: str, space: str | None = None) -> tuple[DataFrame, Node]:
        """A scan of the nodes with any of ``labels``, columns renamed for one variable."""
        tables = self.catalog.node_tables(labels, space)
        if not tables:
            empty = self.spark.createDataFrame([], "_id string, _labels array<string>")
            tables = [NodeTable(empty, None, space or "")]
        spaces = {t.space for t in tables}
        shared = next(iter(spaces)) if len(spaces) == 1 else None
        base = self._name(hint)
        types: dict[str, T.DataType] = {}
        for t in tables:
            for f in t.df.schema:
                if f.name in t.properties:
                    held = types.get(f.name)
                    types[f.name] = f.dataType if held is None or held == f.dataType else T.DoubleType() if is_num(held) and is_num(f.dataType) else STR
        props = {k: (f"{base}_{self._name(k)}", t) for k, t in types.items()}
        meta = {m: f"{base}_{m}" for m in ("createdOn", "updatedOn") if any(m in t.df.columns for t in tables)}
        node = Node(f"{base}_id", shared, f"{base}_labels", props, meta)
        frames = []
        for t in tables:
            df = t.df
            if t.labels is None and labels:
                df = df.where(F.arrays_overlap("_labels", F.array(*[F.lit(x) for x in labels])))
            label = F.array(*[F.lit(x) for x in t.labels]) if t.labels is not None else F.col("_labels")
            key = F.col("_id") if shared is not None else global_id(F.col("_id"), t.space)
            cols = [key.alias(node.id), label.alias(node.labels or "")]
            cols += [(column(k).cast(ty) if k in t.properties else F.lit(None).cast(ty)).alias(c) for k, (c, ty) in props.items()]
            cols += [(F.col(m).cast("long") if m in t.df.columns else F.lit(None).cast("long")).alias(c) for m, c in meta.items()]
            frames.append(df.select(*cols))
        return reduce(DataFrame.unionByName, frames), node

    def edges(self, e: s.EdgePattern, hint: str, near: Node, near_labels: set[str] | None) -> tuple[DataFrame | None, Edge, list[EdgeTable]]:
        """A scan of the edges that can leave ``near`` along ``e``."""
        tables = self.catalog.edge_tables(e.types)
        near_space = (lambda t: t.dst_space) if e.incoming else (lambda t: t.src_space)
        near_label = (lambda t: t.dst_labels) if e.incoming else (lambda t: t.src_labels)
        tables = [t for t in tables if (near.space is None or near_space(t) == near.space) and (near_labels is None or near_label(t) is None or near_labels & set(near_label(t) or ()))]
        base = self._name(hint)
        sides = [{t.src_space for t in tables}, {t.dst_space for t in tables}]
        src_space, dst_space = (next(iter(x)) if len(x) == 1 else None for x in sides)
        types: dict[str, T.DataType] = {}
        for t in tables:
            for f in t.df.schema:
                if f.name not in EDGE_META:
                    held = types.get(f.name)
                    types[f.name] = f.dataType if held is None or held == f.dataType else T.DoubleType() if is_num(held) and is_num(f.dataType) else STR
        props = {k: (f"{base}_{self._name(k)}", t) for k, t in types.items()}
        edge = Edge(f"{base}_id", f"{base}_src", f"{base}_dst", src_space, dst_space, f"{base}_type", props, {m: f"{base}_{m}" for m in ("createdOn", "updatedOn") if any(m in t.df.columns for t in tables)})
        frames = []
        for t in tables:
            df = t.df
            if t.type is None and e.types:
                df = df.where(F.col("_type").isin(list(e.types)))
            label = F.lit(t.type) if t.type is not None else F.col("_type")
            src = F.col("_src") if src_space is not None else global_id(F.col("_src"), t.src_space)
            dst = F.col("_dst") if dst_space is not None else global_id(F.col("_dst"), t.dst_space)
            own = F.col("_id") if len(tables) == 1 else F.concat(label, F.lit(":"), F.col("_id").cast("string")) if t.type is not None else F.col("_id").cast("string")
            cols = [own.alias(edge.id), src.alias(edge.src), dst.alias(edge.dst), label.alias(edge.type)]
            cols += [(column(k).cast(ty) if k in t.properties else F.lit(None).cast(ty)).alias(c) for k, (c, ty) in props.items()]
            cols += [(F.col(m).cast("long") if m in t.df.columns else F.lit(None).cast("long")).alias(c) for m, c in edge.meta.items()]
            frames.append(df.select(*cols))
        return (reduce(DataFrame.unionByName, frames) if frames else None), edge, tables

    def _props(self, rows: Rows, b: Binding, props: tuple[tuple[str, s.Expr], ...]) -> Rows:
        for k, v in props:
            rows = Rows(self._frame(rows).where(self.exprs.truth(s.Binary("=", s.Prop(s.Column(b), k), v), rows.scope)), rows.scope)
        return rows

    def _check_labels(self, rows: Rows, b: Node, labels: tuple[str, ...]) -> Rows:
        if not labels or not b.labels:
            return rows
        return Rows(self._frame(rows).where(F.coalesce(F.arrays_overlap(b.labels, F.array(*[F.lit(x) for x in labels])), F.lit(False))), rows.scope)

    def path(self, rows: Rows, p: s.Path) -> Rows:
        bound = [k for k, n in enumerate(p.nodes) if n.name and n.name in rows.scope]
        for e in p.edges:
            if e.name and e.name in rows.scope and not isinstance(rows.scope[e.name], Edge):
                raise CypherSemanticError(f"Variable '{e.name}' is not a relationship")
        first = bound[0] if bound else self._best_start(p)
        self.lean = self.catalog.complete and p.name in self.sized
        at: dict[int, Node] = {}
        begun = self._start_at_edge(rows, p.nodes[0], p.edges[0]) if first == 0 and p.edges and p.name is None else None
        rows, at[first] = begun or self._start(rows, p.nodes[first])
        self._note("VerifyNode" if bound else "NodeScan", rows)
        known: dict[int, set[str] | None] = {first: set(p.nodes[first].labels) or None}
        pieces: dict[int, Column] = {}
        inner: dict[int, Column] = {}
        for k in range(first, len(p.edges)):
            rows, at[k + 1], pieces[k], inner[k] = self._expand(rows, at[k], known[k], p.edges[k], p.nodes[k + 1], p.name is not None, False)
            self._note("EdgeExpand", rows)
            known[k + 1] = set(p.nodes[k + 1].labels) or None
        for k in range(first - 1, -1, -1):
            e = p.edges[k]
            turned = s.EdgePattern(e.name, e.types, e.props, not e.incoming, e.low, e.high)
            rows, at[k], pieces[k], inner[k] = self._expand(rows, at[k + 1], known[k + 1], turned, p.nodes[k], p.name is not None, True)
            self._note("EdgeExpand", rows)
            known[k] = set(p.nodes[k].labels) or None
        if p.name:
            rows = self._named(rows, p, at, pieces, inner)
        return rows

    def _best_start(self, p: s.Path) -> int:
        """Of an unbound path the end to begin at; joins are declarative, so it only matters for paths of variable length."""
        if any(e.variable for e in p.edges):
            weight = [2 * bool(n.props) + bool(n.labels) for n in p.nodes]
            return max(range(len(weight)), key=lambda k: (weight[k], -k))
        return 0

    def _start(self, rows: Rows, n: s.NodePattern) -> tuple[Rows, Node]:
        if n.name and n.name in rows.scope:
            b = rows.scope[n.name]
            if not isinstance(b, Node):
                raise CypherSemanticError(f"Variable '{n.name}' is not a node")
            rows = Rows(self._frame(rows).where(F.col(b.id).isNotNull()), rows.scope)
            rows = self._check_labels(rows, b, n.labels)
            return self._props(rows, b, n.props), b
        df, b = self.nodes(n.labels, n.name or "n")
        joined = df if rows.df is None else rows.df.crossJoin(df)
        rows = Rows(joined, rows.scope | ({n.name: b} if n.name else {}))
        return self._props(rows, b, n.props), b

    def _start_at_edge(self, rows: Rows, n: s.NodePattern, e: s.EdgePattern) -> tuple[Rows, Node] | None:
        """Begins at the edge table itself where its rows say all that the query reads of the first node."""
        if rows.df is not None or not self.catalog.complete or e.variable or n.props or n.name in self.read or n.name in rows.scope:
            return None
        tables = self.catalog.edge_tables(e.types)
        ends = [t.dst_labels if e.incoming else t.src_labels for t in tables]
        tables = [t for t, x in zip(tables, ends, strict=True) if not n.labels or x is None or set(n.labels) & set(x)]
        if not tables or n.labels and not all(x is not None and set(x) <= set(n.labels) for x in ends if x is None or set(n.labels) & set(x)):
            return None
        edges, edge, tables = self.edges(e, e.name or "r", Node("", None, None, {}), set(n.labels) or None)
        here, space = (edge.dst, edge.dst_space) if e.incoming else (edge.src, edge.src_space)
        self.opened[here] = (edges, edge, tables)
        near = Node(here, space, None, {})
        return Rows(edges, rows.scope | ({n.name: near} if n.name else {})), near

    def _same(self, a: Column, a_space: str | None, b: Column, b_space: str | None) -> Column:
        return a == b if a_space == b_space else global_id(a, a_space) == global_id(b, b_space)

    def _expand(self, rows: Rows, near: Node, near_labels: set[str] | None, e: s.EdgePattern, n: s.NodePattern, named: bool, reversed_: bool) -> tuple[Rows, Node, Column, Column]:
        df = self._frame(rows)
        # later steps of a path of variable length leave from anywhere
        begin = Node(near.id, None, None, {}) if e.variable else near
        opened = self.opened.pop(near.id, None)
        edges, edge, tables = opened or self.edges(e, e.name or "r", begin, None if e.variable else near_labels)
        again = rows.scope.get(e.name) if e.name else None
        if edges is None:
            edges = self.spark.createDataFrame([], f"{edge.id} string, {edge.src} string, {edge.dst} string, {edge.type} string")
            edge = Edge(edge.id, edge.src, edge.dst, near.space, near.space, edge.type, {})
            df = df.where(F.lit(False))
        here, there = (edge.dst, edge.src) if e.incoming else (edge.src, edge.dst)
        here_space, there_space = (edge.dst_space, edge.src_space) if e.incoming else (edge.src_space, edge.dst_space)
        steps = F.array()
        between = F.array()
        if e.variable:
            df, steps, between = trails(self, df, near, edges, edge, e, named, reversed_)
            native = near.space is not None and here_space == there_space == near.space
            far_col, far_space = F.col(f"{edge.id}_cur"), near.space if native else None
        else:
            if opened is None:
                df = df.join(edges, self._same(F.col(near.id), near.space, F.col(here), here_space))
            far_col, far_space = F.col(there), there_space
            if named:
                steps = F.array(edge.struct())
        if isinstance(again, Edge):
            df = df.where(F.col(again.id).cast("string") == F.col(edge.id).cast("string"))
        scope = rows.scope | ({e.name: edge} if e.name else {})
        rows = self._props(Rows(df, scope), edge, e.props)
        df = self._frame(rows)
        target = rows.scope.get(n.name) if n.name else None
        if target is not None:
            if not isinstance(target, Node):
                raise CypherSemanticError(f"Variable '{n.name}' is not a node")
            df = df.where(self._same(far_col, far_space, F.col(target.id), target.space))
            rows = self._check_labels(Rows(df, scope), target, n.labels)
            return self._props(rows, target, n.props), target, steps, between
        ends = [(t.src_labels if e.incoming else t.dst_labels) for t in tables]
        certain = not n.labels or all(x is not None and set(x) <= set(n.labels) for x in ends)
        if self.catalog.complete and certain and not n.props and not named and (n.name is None or n.name not in self.read) and not e.variable:
            b = Node(self._name(n.name or "n") + "_id", far_space, None, {})
            df = df.withColumn(b.id, far_col)
        else:
            found, b = self.nodes(n.labels, n.name or "n", far_space)
            df = df.join(found, self._same(far_col, far_space, F.col(b.id), b.space))
        rows = Rows(df, scope | ({n.name: b} if n.name else {}))
        return self._props(rows, b, n.props), b, steps, between

    def _named(self, rows: Rows, p: s.Path, at: dict[int, Node], pieces: dict[int, Column], inner: dict[int, Column]) -> Rows:
        """path = struct(nodes, rels); entities of different shape are brought to their common fields (JSON properties)."""
        nodes = [entity_value(Node(at[k].id, at[k].space, None, {}) if self.lean else at[k]) for k in range(len(p.nodes))]
        same = all(v.type == nodes[0].type for v in nodes) and not any(e.variable for e in p.edges)
        plain = lambda v: v.col if same else F.when(v.col.isNotNull(), F.struct(v.col["id"].alias("id"), v.col["labels"].alias("labels"), self._as_map(v.col["properties"], v.type["properties"].dataType).alias("properties")))
        parts = [F.array(plain(nodes[0]))]
        for k, e in enumerate(p.edges):
            if e.variable:
                parts.append(inner[k])
            parts.append(F.array(plain(nodes[k + 1])))
        df = self._frame(rows)
        name = self._name(p.name or "p")
        rels = [pieces[k] for k in range(len(p.edges))]
        probe = df.select(*[r.alias(f"r{k}") for k, r in enumerate(rels)]).schema if rels else []
        shapes = {f.dataType.elementType.simpleString() for f in probe}
        if len(shapes) > 1 or any(e.variable for e in p.edges):
            rels = [r if e.variable else F.transform(r, lambda x, f=f: F.struct(x["id"].alias("id"), x["sourceId"].alias("sourceId"), x["targetId"].alias("targetId"), x["type"].alias("type"), self._as_map(x["properties"], f.dataType.elementType["properties"].dataType).alias("properties"))) for r, e, f in zip(rels, p.edges, probe, strict=True)]
        rel = F.concat(*rels) if rels else F.array().cast("array<struct<id:string,sourceId:string,targetId:string,type:string,properties:map<string,string>>>")
        df = df.withColumn(name, F.struct(F.concat(*parts).alias("nodes"), rel.alias("rels")))
        return Rows(df, rows.scope | {p.name: Val(F.col(name), df.schema[name].dataType)})

    @staticmethod
    def _as_map(col: Column, t: T.StructType) -> Column:
        fields = [x for n in t.names if n != "_" for x in (F.lit(n), col[n].cast("string"))]
        return F.create_map(*fields) if fields else F.create_map().cast("map<string,string>")

    # ---------------------------------------------------------------- subqueries

    def _outer(self, scope: Scope, paths: Iterable[s.Path], where: s.Expr | None, extra: Iterable[s.Expr] = ()) -> tuple[list[str], Scope]:
        """Columns of the outer rows that a sub-pattern depends on, and their bindings."""
        cols: list[str] = []
        inner: Scope = {}
        exprs = [*([where] if where else []), *extra]

        def props_of(name: str) -> set[str] | None:
            """Properties read of ``name``; None: all of it."""
            out: set[str] = set()

            def look(x: Any) -> bool:
                if isinstance(x, s.Prop) and isinstance(x.of, s.Var) and x.of.name == name:
                    out.add(x.key)
                    return True
                if isinstance(x, s.Call) and x.name.lower() == "id":
                    return True
                if isinstance(x, s.Var) and x.name == name:
                    return False
                return all([look(y) for y in s.children(x)])

            return out if all([look(e) for e in exprs]) else None

        names = {n for p in paths for n in s.pattern_names(p)}
        seen = names | {x.name for e in exprs for x in s.walk(e) if isinstance(x, s.Var)} | {n for e in exprs for x in s.walk(e) if isinstance(x, (s.Exists, s.PatternExpr, s.PatternComprehension)) for p in (x.paths if isinstance(x, s.Exists) else [x.path]) for n in s.pattern_names(p)}
        patterns = {n.name: n for p in paths for n in p.nodes if n.name}
        for name in sorted(seen & set(scope)):
            b = scope[name]
            if isinstance(b, Val):
                if b.type is None:
                    inner[name] = b
                    continue
                got = self._name(name)
                cols.append(got)
                inner[name] = Val(F.col(got), b.type)
                continue
            keys = props_of(name)
            pattern = patterns.get(name)
            if keys is not None and pattern:
                keys |= {k for k, _ in pattern.props}
            props = b.props if keys is None else {k: v for k, v in b.props.items() if k in keys}
            if isinstance(b, Node):
                slim: Binding = Node(b.id, b.space, b.labels if keys is None or pattern and pattern.labels else None, props, b.meta if keys is None else {})
            else:
                slim = Edge(b.id, b.src, b.dst, b.src_space, b.dst_space, b.type, props, b.meta if keys is None else {})
            inner[name] = slim
            cols += slim.columns()
        return cols, inner

    def _correlate(self, rows: Rows, paths: Iterable[s.Path], where: s.Expr | None, extra: Iterable[s.Expr] = ()) -> tuple[DataFrame, Rows, list[str]]:
        """(outer rows, the pattern's matches for the distinct outer values, names of those columns in both)"""
        cols, inner = self._outer(rows.scope, paths, where, extra)
        self.inside += 1
        try:
            return self._matches_of(rows, paths, where, cols, inner)
        finally:
            self.inside -= 1

    def _matches_of(self, rows: Rows, paths: Iterable[s.Path], where: s.Expr | None, cols: list[str], inner: Scope) -> tuple[DataFrame, Rows, list[str]]:
        df = self._frame(rows)
        plain = [n for n in inner if isinstance(inner[n], Val) and inner[n].type is not None]
        for n in plain:
            held = inner[n]
            assert isinstance(held, Val)
            df = df.withColumn(held.col._jc.toString(), rows.scope[n].col)  # type: ignore[union-attr]
        if not cols:
            return df, self.match(Rows(None, dict(inner)), paths, where), []
        seeds = df.select(*cols).distinct()
        return df, self.match(Rows(seeds, dict(inner)), paths, where), cols

    def _join_back(self, df: DataFrame, sub: DataFrame, cols: list[str], how: str, strict: set[str] = frozenset()) -> DataFrame:  # type: ignore[assignment]
        """``strict``: columns that no match has as null, so plain equality will do."""
        if not cols:
            if how in ("left_semi", "left_anti"):
                return df.join(sub.limit(1), F.lit(True), how)
            return df.join(sub, F.lit(True), how)
        other = {c: self._name("o") for c in cols}
        sub = sub.withColumnsRenamed(other)
        cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(o) if c in strict else F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
        out = df.join(sub, cond, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*other.values())

    @staticmethod
    def _strict(scope: Scope, paths: Iterable[s.Path]) -> set[str]:
        return {b.id for p in paths for n in p.nodes if n.name and isinstance(b := scope.get(n.name), Node)}

    def semi(self, rows: Rows, e: s.Exists, negated: bool) -> Rows:
        df, sub, cols = self._correlate(rows, e.paths, e.where)
        out = self._join_back(df, self._frame(sub).select(*cols) if cols else self._frame(sub), cols, "left_anti" if negated else "left_semi", self._strict(rows.scope, e.paths))
        return Rows(out, rows.scope)

    def optional(self, rows: Rows, c: s.Match) -> Rows:
        df, sub, cols = self._correlate(rows, c.paths, c.where)
        new = {n: b for n, b in sub.scope.items() if n not in rows.scope}
        keep = [x for b in new.values() for x in (b.columns() if isinstance(b, (Node, Edge)) else [b.col._jc.toString()])]
        if rows.df is None:
            df = self.spark.range(1).select(F.lit(1).alias(_UNIT))
        out = self._join_back(df, self._frame(sub).select(*cols, *dict.fromkeys(keep)), cols, "left", self._strict(rows.scope, c.paths))
        return Rows(out, rows.scope | new)

    def extract(self, rows: Rows, e: s.Expr) -> tuple[Rows, s.Expr]:
        """Evaluates the subqueries in ``e``; they are replaced by the columns that hold their outcome."""
        found: list[s.Expr] = []

        def look(x: Any) -> Any:
            if isinstance(x, s.Call) and x.name.lower() == "size" and len(x.args) == 1 and isinstance(x.args[0], s.PatternExpr):
                found.append(x)
                return x
            if isinstance(x, (s.Exists, s.PatternExpr, s.PatternComprehension)):
                found.append(x)
                return x
            return None

        e = as_predicate(e) if not isinstance(e, s.PatternExpr) else e
        if isinstance(e, s.Case):
            e = s.Case(e.subject, tuple((as_predicate(a), b) for a, b in e.branches), e.default)
        s.rewrite(e, look)
        for x in found:
            rows, value = self._subquery(rows, x)
            e = s.rewrite(e, lambda y, x=x, value=value: s.Column(value) if y is x or y == x else None)
        return rows, e

    def _subquery(self, rows: Rows, x: Any) -> tuple[Rows, Val]:
        name = self._name("sub")
        if isinstance(x, s.Exists):
            df, sub, cols = self._correlate(rows, x.paths, x.where)
            marks = self._frame(sub).select(*cols).distinct() if cols else self._frame(sub).limit(1).select()
            out = self._join_back(df, marks.withColumn(name, F.lit(True)), cols, "left", self._strict(rows.scope, x.paths))
            return Rows(out, rows.scope), Val(F.coalesce(F.col(name), F.lit(False)), BOOL)
        counted = isinstance(x, s.Call)
        if isinstance(x, s.PatternComprehension):
            if has_aggregate(x.result) or x.where is not None and has_aggregate(x.where):
                raise CypherSemanticError("A pattern comprehension cannot hold an aggregate")
            path, where, result = x.path, x.where, x.result
        else:
            pattern = x.args[0] if counted else x
            path, where, result = pattern.path, None, None
            if not counted:
                path = s.Path(path.name or "\0path", path.nodes, path.edges)
                result = s.Var(path.name)
        saved = self.read
        if result is not None:
            self.read = self.read | names_read(result) | {y.name for y in s.walk(result) if isinstance(y, s.Var)}
        df, sub, cols = self._correlate(rows, [path], where, [result] if isinstance(x, s.PatternComprehension) else [])
        self.read = saved
        found = self._frame(sub)
        if counted:
            agg, empty, t = F.count(F.lit(1)), F.lit(0).cast("long"), LONG
        else:
            sub, result = self.extract(sub, result)
            found = self._frame(sub)
            v = self.exprs.value(result, sub.scope)
            t = T.ArrayType(v.type or STR)
            agg = F.transform(F.collect_list(F.struct(v.col.alias("x"))), lambda y: y["x"])
            empty = F.array().cast(t)
        grouped = (found.groupBy(*cols) if cols else found.groupBy()).agg(agg.alias(name))
        out = self._join_back(df, grouped, cols, "left", self._strict(rows.scope, [path]))
        return Rows(out, rows.scope), Val(F.coalesce(F.col(name), empty), t)

    # ---------------------------------------------------------------- projection

    @staticmethod
    def _sort(col: Column, descending: bool) -> Column:
        return col.desc_nulls_last() if descending else col.asc_nulls_first()

    def _count(self, e: s.Expr, what: str) -> int:
        if isinstance(e, s.Param) and e.name not in self.params:
            raise UnboundParameterError(f"Parameter '${e.name}' is not bound")
        value = e.value if isinstance(e, s.Lit) else self.params[e.name] if isinstance(e, s.Param) else None
        if value is None and not isinstance(e, (s.Lit, s.Param)):
            value = self.spark.range(1).select(self.exprs.value(e, {}).col.alias("n")).first()["n"]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < 0:
            raise CypherRuntimeError(f"{what} must be a non-negative integer, got {value!r}")
        return int(value)

    def _cut(self, df: DataFrame, skip: s.Expr | None, limit: s.Expr | None) -> DataFrame:
        if skip is not None and (n := self._count(skip, "SKIP")):
            df = df.offset(n)
        return df.limit(self._count(limit, "LIMIT")) if limit is not None else df

    def project(self, rows: Rows, p: s.Projection, final: bool) -> Rows:
        items = list(p.items)
        if not final:
            for i in items:
                if not i.alias and not isinstance(i.expr, (s.Var, s.Prop)):
                    raise CypherSemanticError("WITH needs AS after an expression")
        if p.star:
            taken = {alias_of(i) for i in items}
            items = [s.Item(s.Var(n), n) for n in rows.scope if n not in taken and not n.startswith("\0")] + items
        for i in items:
            for x in s.walk(i.expr):
                if isinstance(x, s.Comprehension) and any(has_aggregate(y) for y in s.children(x)):
                    raise CypherSemanticError("A list comprehension cannot hold an aggregate")
        aggregated = any(has_aggregate(i.expr) for i in items) or any(has_aggregate(o.expr) for o in p.order)
        order = list(p.order)
        if aggregated:
            rows, items, order = self._aggregate(rows, items, order)
            self._note("Aggregate", rows)
        scope: Scope = {}
        made: list[tuple[str, Binding, Val | None]] = []
        aliases = []
        for i in items:
            rows, e = self.extract(rows, i.expr)
            b = self.exprs.compile(e, rows.scope)
            aliases.append(alias_of(i))
            made.append((aliases[-1], b, None))
        sorts: list[tuple[str, bool]] = []
        df = self._frame(rows)
        new: list[Column] = []
        for alias, b, _ in made:
            if isinstance(b, (Node, Edge)):
                scope[alias] = b
                continue
            name = self._name(alias)
            new.append(b.col.alias(name))
            scope[alias] = Val(F.col(name), b.type)
        df = df.select("*", *new)
        rows = Rows(df, (rows.scope if not p.distinct and not aggregated else {}) | scope)
        if p.distinct:
            keys = [b.id if isinstance(b, (Node, Edge)) else b.col._jc.toString() for b in scope.values()]
            keep = list(dict.fromkeys(c for b in scope.values() for c in (b.columns() if isinstance(b, (Node, Edge)) else [b.col._jc.toString()])))
            df = df.select(*keep)
            # maps, as in paths, have no equality: they are told apart by their JSON
            keys = list(dict.fromkeys(keys))
            told = {k: self._name("key") for k in keys if "map<" in df.schema[k].dataType.simpleString()}
            df = df.withColumns({n: F.to_json(F.struct(k)) for k, n in told.items()})
            rows.df = df.dropDuplicates([told.get(k, k) for k in keys]).drop(*told.values())
        self._note("Project", rows)
        if p.where is not None:
            rows = Rows(rows.df, scope | {k: v for k, v in rows.scope.items() if k.startswith("\0")})
            kept = self.where(Rows(rows.df, scope), p.where)
            rows = Rows(kept.df, (rows.scope if order else {}) | scope)
        for o in order:
            rows, e = self.extract(rows, o.expr)
            e = self._alias_first(e, items, scope)
            v = self.exprs.value(e, rows.scope)
            name = self._name("sort")
            rows = Rows(self._frame(rows).withColumn(name, v.col["id"] if isinstance(v.type, T.StructType) and "id" in v.type.names else v.col), rows.scope)
            sorts.append((name, o.descending))
        df = self._frame(rows)
        if sorts:
            df = df.orderBy(*[self._sort(F.col(n), d) for n, d in sorts])
            self._note("Sort", Rows(df, scope))
        df = self._cut(df, p.skip, p.limit)
        if p.skip or p.limit:
            self._note("Limit", Rows(df, scope))
        if final:
            out = []
            for a in aliases:
                b = scope[a]
                v = entity_value(b) if isinstance(b, (Node, Edge)) else b
                out.append(v.col.alias(a))
            return Rows(df.select(*out), scope)
        keep = list(dict.fromkeys(c for b in scope.values() for c in (b.columns() if isinstance(b, (Node, Edge)) else [b.col._jc.toString()])))
        return Rows(df.select(*keep) if keep else df.select(F.lit(1).alias(_UNIT)), scope)

    @staticmethod
    def _alias_first(e: s.Expr, items: list[s.Item], scope: Scope) -> s.Expr:
        """Sorting by the very expression of an item sorts by the item."""
        for i in items:
            if i.expr == e and alias_of(i) in scope:
                return s.Var(alias_of(i))
        return e

    # ---------------------------------------------------------------- aggregation

    def _aggregate(self, rows: Rows, items: list[s.Item], order: list[s.SortItem]) -> tuple[Rows, list[s.Item], list[s.SortItem]]:
        keys = [i for i in items if not has_aggregate(i.expr)]
        for i in keys:
            if not isinstance(i.expr, (s.Var, s.Prop)):
                raise CypherSemanticError("A grouping key must be a variable or a property access")
        scope: Scope = {}
        by: list[Column] = []
        carried: list[Column] = []
        swaps: list[tuple[s.Expr, Any]] = []
        for i in keys:
            b = self.exprs.compile(i.expr, rows.scope)
            alias = alias_of(i)
            if isinstance(b, (Node, Edge)):
                by.append(F.col(b.id))
                carried += [F.first(c).alias(c) for c in b.columns() if c != b.id]
                scope[alias] = b
            else:
                name = self._name(alias)
                by.append(b.col.alias(name))
                scope[alias] = Val(F.col(name), b.type)
            swaps.append((i.expr, scope[alias]))
        aggs: list[Column] = []
        made: dict[s.Expr, Val] = {}

        def swap(x: Any) -> Any:
            nonlocal rows
            for e, b in swaps:
                if x == e:
                    return s.Column(b)
            if is_aggregate(x):
                if x not in made:
                    args = []
                    for a in x.args:
                        if has_aggregate(a):
                            raise CypherSemanticError("Aggregate functions cannot be nested")
                        rows, a2 = self.extract(rows, a)
                        args.append(a2)
                    col, t = self._aggregate_column(s.Call(x.name, tuple(args), x.distinct, x.star), rows.scope)
                    name = self._name(x.name)
                    aggs.append(col.alias(name))
                    made[x] = Val(F.col(name), t)
                return s.Column(made[x])
            return None

        new_items = [s.Item(s.rewrite(i.expr, swap), alias_of(i)) for i in items]
        aliases = {alias_of(i): n.expr for i, n in zip(items, new_items, strict=True)}

        def swap_order(x: Any) -> Any:
            if isinstance(x, s.Var) and x.name in aliases:
                return aliases[x.name]
            return swap(x)

        new_order = [s.SortItem(s.rewrite(o.expr, swap_order), o.descending) for o in order]
        allowed = {alias_of(i) for i in keys}
        for o in new_order:
            for x in s.walk(o.expr):
                if isinstance(x, s.Var) and x.name not in allowed:
                    raise CypherSemanticError(f"ORDER BY after aggregation may only refer to returned columns, not '{x.name}'")
        df = self._frame(rows)
        seen = {}
        carried = [seen.setdefault(str(c), c) for c in carried if str(c) not in seen]
        df = (df.groupBy(*by) if by else df.groupBy()).agg(*(aggs + carried or [F.count(F.lit(1)).alias(_UNIT)]))
        return Rows(df, scope), new_items, new_order

    def _aggregate_column(self, x: s.Call, scope: Scope) -> tuple[Column, T.DataType | None]:
        name = x.name.lower()
        if x.star:
            return (F.coalesce(F.sum(self.weight), F.lit(0)) if self.weight else F.count(F.lit(1))), LONG
        if len(x.args) != 1:
            raise CypherRuntimeError(f"{x.name}() expects exactly 1 argument, got {len(x.args)}")
        if isinstance(x.args[0], s.Lit) and x.args[0].value == "*" and name == "count":
            return F.count(F.lit(1)), LONG
        b = self.exprs.compile(x.args[0], scope)
        if name == "count":
            col = F.col(b.id) if isinstance(b, (Node, Edge)) else b.col
            return (F.count_distinct(col) if x.distinct else F.count(col)), LONG
        v = entity_value(b) if isinstance(b, (Node, Edge)) else b
        if name == "collect":
            comparable = v.type is not None and "map<" not in v.type.simpleString()
            return (F.collect_set if x.distinct and comparable else F.collect_list)(v.col), T.ArrayType(v.type or STR)
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(v.col), v.type
        col = v.col
        integral = isinstance(v.type, T.IntegralType)
        if isinstance(v.type, T.BooleanType):
            col, integral = col.cast("long"), True
        elif is_str(v.type) or v.type is None:
            col = col.try_cast("double")
        elif not is_num(v.type):
            raise CypherRuntimeError(f"{name}() requires numbers, got {kind(v.type)}")
        if name == "sum":
            total = F.sum_distinct(col) if x.distinct else F.sum(col)
            return F.coalesce(total, F.lit(0).cast("long") if integral else F.lit(0.0)), LONG if integral else T.DoubleType()
        if x.distinct:
            return F.coalesce(F.sum_distinct(col.cast("double")) / F.nullif(F.count_distinct(col), F.lit(0)), F.lit(0.0)), T.DoubleType()
        return F.coalesce(F.avg(col), F.lit(0.0)), T.DoubleType()


def explain(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


__all__ = ["Compiler", "Rows", "explain", "null", "truth"]
