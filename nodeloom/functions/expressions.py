"""Expressions: syntax tree to Spark columns with a static type.

Comparisons are three-valued; AND, OR, XOR, NOT, WHERE and CASE take the truth of their operands, where null, false, 0,
NaN and the empty string are false. Equality is null-safe and never converts between kinds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.errors import CypherRuntimeError, CypherSemanticError, TypeMismatchError, UnboundParameterError
from nodeloom.functions.registry import lookup
from nodeloom.plans import syntax as s
from nodeloom.plans.parser import is_aggregate
from nodeloom.sources.catalog import global_id, quoted


@dataclass(frozen=True)
class Val:
    """A compiled expression; ``type`` None: always null."""

    col: Column
    type: T.DataType | None


@dataclass(frozen=True)
class Node:
    """A bound node: the names of its columns in the rows."""

    id: str
    space: str | None
    labels: str | None
    props: dict[str, tuple[str, T.DataType]] = field(hash=False)
    meta: dict[str, str] = field(default_factory=dict, hash=False)

    def columns(self) -> list[str]:
        return [self.id, *([self.labels] if self.labels else []), *(c for c, _ in self.props.values()), *self.meta.values()]

    def identity(self) -> Column:
        return global_id(F.col(self.id), self.space)

    def struct(self) -> Column:
        props = [F.col(c).alias(k) for k, (c, _) in sorted(self.props.items())]
        labels = F.col(self.labels) if self.labels else F.array().cast("array<string>")
        body = F.struct(self.identity().alias("id"), labels.alias("labels"), (F.struct(*props) if props else F.struct(F.lit(None).cast("string").alias("_"))).alias("properties"))
        return F.when(F.col(self.id).isNotNull(), body)


@dataclass(frozen=True)
class Edge:
    id: str
    src: str
    dst: str
    src_space: str | None
    dst_space: str | None
    type: str
    props: dict[str, tuple[str, T.DataType]] = field(hash=False)
    meta: dict[str, str] = field(default_factory=dict, hash=False)

    def columns(self) -> list[str]:
        return [self.id, self.src, self.dst, self.type, *(c for c, _ in self.props.values()), *self.meta.values()]

    def identity(self) -> Column:
        return F.col(self.id).cast("string")

    def struct(self) -> Column:
        props = [F.col(c).alias(k) for k, (c, _) in sorted(self.props.items())]
        body = F.struct(self.identity().alias("id"), global_id(F.col(self.src), self.src_space).alias("sourceId"), global_id(F.col(self.dst), self.dst_space).alias("targetId"), F.col(self.type).alias("type"), (F.struct(*props) if props else F.struct(F.lit(None).cast("string").alias("_"))).alias("properties"))
        return F.when(F.col(self.id).isNotNull(), body)


Binding = Node | Edge | Val
Scope = dict[str, Binding]


def null() -> Val:
    return Val(F.lit(None).cast("string"), None)


STR, BOOL, LONG, DOUBLE = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()


def is_num(t: T.DataType | None) -> bool:
    return isinstance(t, T.NumericType)


def is_str(t: T.DataType | None) -> bool:
    return isinstance(t, T.StringType)


def is_list(t: T.DataType | None) -> bool:
    return isinstance(t, T.ArrayType)


def is_entity(t: T.DataType | None) -> bool:
    return isinstance(t, T.StructType) and {"id", "properties"} <= set(t.names)


def is_path(t: T.DataType | None) -> bool:
    return isinstance(t, T.StructType) and t.names == ["nodes", "rels"]


def kind(t: T.DataType | None) -> str:
    if t is None:
        return "null"
    if is_num(t):
        return "number"
    if is_str(t):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "list" if is_list(t) else "entity" if is_entity(t) else "path" if is_path(t) else "object"


def truth(v: Val) -> Column:
    if v.type is None:
        return F.lit(False)
    if isinstance(v.type, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if is_num(v.type):
        nonzero = v.col != 0
        return F.coalesce(nonzero & ~F.isnan(v.col) if isinstance(v.type, (T.DoubleType, T.FloatType)) else nonzero, F.lit(False))
    if is_str(v.type):
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def _comparable(a: Val, b: Val) -> bool:
    return kind(a.type) == kind(b.type) or type(a.type) is type(b.type)


def equal(a: Val, b: Val) -> Column:
    if a.type is None or b.type is None:
        return a.col.isNull() & b.col.isNull()
    if is_entity(a.type) and is_entity(b.type):
        return a.col["id"].eqNullSafe(b.col["id"])
    if not _comparable(a, b) and not (isinstance(a.type, (T.DateType, T.TimestampType)) or isinstance(b.type, (T.DateType, T.TimestampType))):
        return a.col.isNull() & b.col.isNull()
    return a.col.eqNullSafe(b.col)


def _literal(value: Any) -> Val:
    if value is None:
        return null()
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL)
    if isinstance(value, int):
        return Val(F.lit(value).cast("long"), LONG)
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE)
    if isinstance(value, str):
        return Val(F.lit(value), STR)
    if isinstance(value, (list, tuple)):
        return list_of([_literal(x) for x in value])
    if isinstance(value, dict):
        return map_of([(k, _literal(v)) for k, v in value.items()])
    return Val(F.lit(value), None if value is None else _spark_type(value))


def _spark_type(value: Any) -> T.DataType:
    import datetime

    return T.TimestampType() if isinstance(value, datetime.datetime) else T.DateType() if isinstance(value, datetime.date) else STR


def list_of(items: list[Val]) -> Val:
    known = [v for v in items if v.type is not None]
    if not known:
        return Val(F.array(*[v.col for v in items]).cast("array<string>"), T.ArrayType(STR))
    kinds = {kind(v.type) for v in known}
    if kinds == {"number"}:
        t = LONG if all(isinstance(v.type, T.IntegralType) for v in known) else DOUBLE
        return Val(F.array(*[v.col.cast(t) for v in items]), T.ArrayType(t))
    if len(kinds) > 1:
        t = T.VariantType()
        return Val(F.array(*[v.col.cast(t) if v.type is not None else F.lit(None).cast(t) for v in items]), T.ArrayType(t))
    t = known[0].type
    return Val(F.array(*[v.col if v.type is not None else F.lit(None).cast(t) for v in items]), T.ArrayType(t))


def map_of(entries: list[tuple[str, Val]]) -> Val:
    if not entries:
        return Val(F.struct(F.lit(None).cast("string").alias("_")), T.StructType([T.StructField("_", STR)]))
    return Val(F.struct(*[v.col.alias(k) for k, v in entries]), T.StructType([T.StructField(k, v.type or STR) for k, v in entries]))


def _text(v: Val) -> Column:
    """As string; whole doubles without a fraction."""
    if isinstance(v.type, (T.DoubleType, T.FloatType)):
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    return v.col.cast("string")


def _add(a: Val, b: Val) -> Val:
    if is_list(a.type) or is_list(b.type):
        if a.type is None or b.type is None:
            return null()
        if is_list(a.type) and is_list(b.type):
            return Val(F.concat(a.col, b.col), a.type)
        whole, one = (a, b) if is_list(a.type) else (b, a)
        item = one.col.cast(whole.type.elementType)
        return Val(F.array_append(whole.col, item) if whole is a else F.array_prepend(whole.col, item), whole.type)
    if a.type is None or b.type is None:
        return null()
    if is_num(a.type) and is_num(b.type):
        return Val(a.col + b.col, _wider(a, b))
    scalars = {"string", "number", "boolean"}
    if (is_str(a.type) or is_str(b.type)) and {kind(a.type), kind(b.type)} <= scalars:
        return Val(F.concat(_text(a), _text(b)), STR)
    raise TypeMismatchError(f"Cannot apply '+' to {kind(a.type)} and {kind(b.type)}")


def _wider(a: Val, b: Val) -> T.DataType:
    return LONG if isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType) else DOUBLE


def _arithmetic(op: str, a: Val, b: Val) -> Val:
    for v in (a, b):
        if v.type is not None and not is_num(v.type):
            raise TypeMismatchError(f"Cannot apply '{op}' to {kind(a.type)} and {kind(b.type)}")
    if a.type is None or b.type is None:
        return null()
    if op == "/":
        return Val(a.col.cast("double") / b.col.cast("double"), DOUBLE)
    if op == "^":
        return Val(F.pow(a.col, b.col), DOUBLE)
    col = a.col - b.col if op == "-" else a.col * b.col if op == "*" else a.col % b.col
    return Val(col, _wider(a, b))


def _order(op: str, a: Val, b: Val) -> Val:
    dates = (T.DateType, T.TimestampType)
    mixed = isinstance(a.type, dates) and (is_str(b.type) or isinstance(b.type, dates)) or isinstance(b.type, dates) and is_str(a.type)
    if not mixed and not (is_num(a.type) and is_num(b.type) or is_str(a.type) and is_str(b.type)):
        return Val(F.lit(None).cast("boolean"), BOOL)
    col = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
    for v in (a, b):
        if isinstance(v.type, (T.DoubleType, T.FloatType)):  # Spark orders NaN above all numbers; here it compares with nothing
            col = col & ~F.isnan(v.col)
    return Val(col, BOOL)


class Expressions:
    def __init__(self, params: dict[str, Any] | None = None) -> None:
        self.params = params or {}

    def value(self, e: s.Expr, scope: Scope) -> Val:
        """Compiled; nodes and edges as structs."""
        b = self.compile(e, scope)
        if isinstance(b, (Node, Edge)):
            return entity_value(b)
        return b

    def truth(self, e: s.Expr, scope: Scope) -> Column:
        return truth(self.value(e, scope))

    def compile(self, e: s.Expr, scope: Scope) -> Binding:
        if isinstance(e, s.Column):
            return e.value
        if isinstance(e, s.Lit):
            return _literal(e.value)
        if isinstance(e, s.Param):
            if e.name not in self.params:
                raise UnboundParameterError(f"Parameter '${e.name}' is not bound")
            return _literal(self.params[e.name])
        if isinstance(e, s.Var):
            if e.name not in scope:
                raise CypherSemanticError(f"Variable '{e.name}' is not defined")
            return scope[e.name]
        if isinstance(e, s.Prop):
            return self._property(self.compile(e.of, scope), e.key)
        if isinstance(e, s.Binary):
            return self._binary(e, scope)
        if isinstance(e, s.Unary):
            if e.op == "NOT":
                return Val(~self.truth(e.of, scope), BOOL)
            v = self.value(e.of, scope)
            if v.type is None:
                return v
            if not is_num(v.type):
                raise TypeMismatchError(f"Unary '-' requires a number, got {kind(v.type)}")
            return Val(-v.col, v.type)
        if isinstance(e, s.IsNull):
            b = self.compile(e.of, scope)
            col = F.col(b.id) if isinstance(b, (Node, Edge)) else b.col
            return Val(col.isNotNull() if e.negated else col.isNull(), BOOL)
        if isinstance(e, s.InList):
            found = self._in(e, scope)
            return Val(~found, BOOL) if e.negated else Val(found, BOOL)
        if isinstance(e, s.Case):
            return self._case(e, scope)
        if isinstance(e, s.ListOf):
            return list_of([self.value(x, scope) for x in e.items])
        if isinstance(e, s.MapOf):
            return map_of([(k, self.value(v, scope)) for k, v in e.entries])
        if isinstance(e, s.Quantifier):
            return self._quantifier(e, scope)
        if isinstance(e, s.Comprehension):
            return self._comprehension(e, scope)
        if isinstance(e, s.Call):
            return self._call(e, scope)
        raise CypherRuntimeError(f"Unsupported expression: {type(e).__name__}")

    def _property(self, b: Binding, key: str) -> Val:
        if isinstance(b, Node):
            if key in b.props:
                return Val(F.col(b.props[key][0]), b.props[key][1])
            if key == "id":
                return Val(b.identity(), STR)
            if key == "labels" and b.labels:
                return Val(F.col(b.labels), T.ArrayType(STR))
            return Val(F.col(b.meta[key]), LONG) if key in b.meta else null()
        if isinstance(b, Edge):
            if key in b.props:
                return Val(F.col(b.props[key][0]), b.props[key][1])
            own = {"id": b.identity(), "type": F.col(b.type), "sourceId": global_id(F.col(b.src), b.src_space), "targetId": global_id(F.col(b.dst), b.dst_space)}
            if key in own:
                return Val(own[key], STR)
            return Val(F.col(b.meta[key]), LONG) if key in b.meta else null()
        if b.type is None:
            return null()
        if is_entity(b.type):
            inner = b.type["properties"].dataType
            if isinstance(inner, T.MapType):
                return Val(b.col[key], STR) if key in b.type.names and key != "properties" else Val(F.try_element_at(b.col["properties"], F.lit(key)), STR)
            if key in inner.names:
                return Val(b.col["properties"][key], inner[key].dataType)
            return Val(b.col[key], b.type[key].dataType) if key in b.type.names else null()
        if isinstance(b.type, T.StructType):
            return Val(b.col[key], b.type[key].dataType) if key in b.type.names else null()
        if isinstance(b.type, T.MapType):
            return Val(b.col[key], b.type.valueType)
        raise TypeMismatchError(f"Cannot access property '{key}' on {kind(b.type)}")

    def _binary(self, e: s.Binary, scope: Scope) -> Val:
        op = e.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.truth(e.left, scope), self.truth(e.right, scope)
            return Val(a & b if op == "AND" else a | b if op == "OR" else a != b, BOOL)
        if op in ("=", "<>"):
            x, y = self.compile(e.left, scope), self.compile(e.right, scope)
            if isinstance(x, (Node, Edge)) and isinstance(y, (Node, Edge)):
                same = x.identity().eqNullSafe(y.identity()) if type(x) is type(y) else F.lit(False)
                if isinstance(x, Node) and isinstance(y, Node) and x.space == y.space:
                    same = F.col(x.id).eqNullSafe(F.col(y.id))
            else:
                native = self._native_id(e.left, e.right, scope)
                native = self._native_id(e.right, e.left, scope) if native is None else native
                if native is not None:
                    same = native
                else:
                    same = equal(*(entity_value(v) if isinstance(v, (Node, Edge)) else v for v in (x, y)))
            return Val(same if op == "=" else ~same, BOOL)
        a, b = self.value(e.left, scope), self.value(e.right, scope)
        if op in ("<", "<=", ">", ">="):
            return _order(op, a, b)
        if op == "+":
            return _add(a, b)
        if op in ("-", "*", "/", "%", "^"):
            return _arithmetic(op, a, b)
        if a.type is None or b.type is None:
            return Val(F.lit(None).cast("boolean"), BOOL)
        if not (is_str(a.type) and is_str(b.type)):
            return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), BOOL)
        if op == "STARTS WITH":
            return Val(F.startswith(a.col, b.col), BOOL)
        if op == "ENDS WITH":
            return Val(F.endswith(a.col, b.col), BOOL)
        if op == "CONTAINS":
            return Val(F.contains(a.col, b.col), BOOL)
        if isinstance(e.right, (s.Lit, s.Param)):
            pattern = e.right.value if isinstance(e.right, s.Lit) else self.params[e.right.name]
            spark = SparkSession.getActiveSession()
            if spark is not None and isinstance(pattern, str):
                try:  # by the engine that will run it
                    spark._jvm.java.util.regex.Pattern.compile(pattern)
                except IllegalArgumentException as error:
                    raise CypherRuntimeError(f"Not a regular expression: {pattern}") from error
        return Val(F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")$"))), BOOL)

    def _native_id(self, call: s.Expr, other: s.Expr, scope: Scope) -> Column | None:
        """id(n) = constant, compared in the key's own type so that it reaches the scan."""
        if not (isinstance(call, s.Call) and call.name.lower() == "id" and len(call.args) == 1 and isinstance(other, (s.Lit, s.Param))):
            return None
        b = self.compile(call.args[0], scope)
        if not isinstance(b, Node) or not b.space:
            return None
        value = other.value if isinstance(other, s.Lit) else self.params.get(other.name)
        if not isinstance(value, str) or not value.startswith(f"{b.space}:"):
            return F.lit(False)
        return F.coalesce(F.col(b.id) == F.lit(value[len(b.space) + 1 :]).try_cast("bigint"), F.lit(False))

    def _in(self, e: s.InList, scope: Scope) -> Column:
        items = e.items
        if isinstance(items, s.Param):
            held = self.params.get(items.name)
            if items.name in self.params and isinstance(held, (list, tuple)):
                items = s.ListOf(tuple(s.Lit(x) for x in held))
        v = self.value(e.of, scope)
        if isinstance(items, s.ListOf):
            if not items.items:
                return F.lit(False)
            if all(isinstance(x, s.Lit) for x in items.items) and v.type is not None:
                same = [x.value for x in items.items if x.value is not None and kind(_literal(x.value).type) == kind(v.type)]
                found = F.coalesce(v.col.isin(same), F.lit(False)) if same else F.lit(False)
                return found | v.col.isNull() if any(x.value is None for x in items.items) else found
            out = F.lit(False)
            for x in items.items:
                out = out | equal(v, self.value(x, scope))
            return out
        held = self.value(items, scope)
        if held.type is None:
            return F.lit(None).cast("boolean")
        if not is_list(held.type):
            raise TypeMismatchError(f"Right-hand side of IN must be a list, got {kind(held.type)}")
        return F.exists(held.col, lambda x: equal(v, Val(x, held.type.elementType)))

    def _case(self, e: s.Case, scope: Scope) -> Val:
        subject = self.value(e.subject, scope) if e.subject else None
        results = [self.value(r, scope) for _, r in e.branches]
        default = self.value(e.default, scope) if e.default else null()
        known = [v for v in (*results, default) if v.type is not None]
        t = known[0].type if known else None
        if known and all(is_num(v.type) for v in known) and not all(isinstance(v.type, T.IntegralType) for v in known):
            t = DOUBLE
        elif len({kind(v.type) for v in known}) > 1:
            t = T.VariantType()
        fit = lambda v: v.col.cast(t) if t is not None and (v.type is None or v.type != t) else v.col
        col = None
        for (test, _), result in zip(e.branches, results, strict=True):
            hit = equal(subject, self.value(test, scope)) if subject else self.truth(test, scope)
            col = F.when(hit, fit(result)) if col is None else col.when(hit, fit(result))
        return Val(col.otherwise(fit(default)), t)

    def _list(self, e: s.Expr, scope: Scope, what: str) -> Val:
        v = self.value(e, scope)
        if v.type is not None and not is_list(v.type):
            raise TypeMismatchError(f"{what} requires a list, got {kind(v.type)}")
        return v

    def _quantifier(self, e: s.Quantifier, scope: Scope) -> Val:
        v = self._list(e.items, scope, "List predicate")
        if v.type is None:
            return Val(F.lit(None).cast("boolean"), BOOL)
        test = lambda x: self.truth(e.where, scope | {e.name: Val(x, v.type.elementType)}) if e.where else truth(Val(x, v.type.elementType))
        col = {"ALL": lambda: F.forall(v.col, test), "ANY": lambda: F.exists(v.col, test), "NONE": lambda: ~F.exists(v.col, test), "SINGLE": lambda: F.size(F.filter(v.col, test)) == 1}[e.kind]()
        return Val(F.when(v.col.isNotNull(), col), BOOL)

    def _comprehension(self, e: s.Comprehension, scope: Scope) -> Val:
        v = self._list(e.items, scope, "List comprehension")
        if v.type is None:
            return null()
        col, item = v.col, v.type.elementType
        inner = lambda x: scope | {e.name: Val(x, item)}
        if e.where:
            col = F.filter(col, lambda x: self.truth(e.where, inner(x)))
        if not e.result:
            return Val(col, v.type)
        out: list[T.DataType | None] = []

        def result(x: Column) -> Column:
            r = self.value(e.result, inner(x))
            out.append(r.type)
            return r.col

        col = F.transform(col, result)
        return Val(col, T.ArrayType(out[0] or STR))

    def _call(self, e: s.Call, scope: Scope) -> Val:
        name = e.name.lower()
        if is_aggregate(e):
            raise CypherSemanticError(f"Aggregate function '{e.name}' is not allowed here")
        if name in ("id", "nodes", "relationships", "labels", "type", "size"):
            if len(e.args) != 1:
                raise CypherRuntimeError(f"{name}() expects exactly 1 argument, got {len(e.args)}")
            b = self.compile(e.args[0], scope)
            t = b.type if isinstance(b, Val) else None
            if isinstance(b, Val) and t is None:
                return null()
            if name == "id":
                if isinstance(b, (Node, Edge)):
                    return Val(b.identity(), STR)
                if is_entity(t):
                    return Val(b.col["id"], STR)
                raise CypherRuntimeError(f"id() requires a node or relationship argument, got {kind(t)}")
            if name == "labels":
                if isinstance(b, Node):
                    return Val(F.col(b.labels) if b.labels else F.array().cast("array<string>"), T.ArrayType(STR))
                if is_entity(t) and "labels" in t.names:
                    return Val(b.col["labels"], T.ArrayType(STR))
                raise CypherRuntimeError(f"labels() requires a node argument, got {'relationship' if isinstance(b, Edge) else kind(t)}")
            if name == "type":
                if isinstance(b, Edge):
                    return Val(F.col(b.type), STR)
                if is_entity(t) and "type" in t.names:
                    return Val(b.col["type"], STR)
                raise CypherRuntimeError(f"type() requires a relationship argument, got {'node' if isinstance(b, Node) else kind(t)}")
            if name == "size":
                if isinstance(b, Val) and is_list(t):
                    return Val(F.when(b.col.isNotNull(), F.size(b.col)).cast("long"), LONG)
                raise CypherRuntimeError(f"size() requires a list argument, got {kind(t) if isinstance(b, Val) else 'entity'}")
            if isinstance(b, Val) and is_path(t):
                part = "nodes" if name == "nodes" else "rels"
                return Val(b.col[part], t[part].dataType)
            raise CypherRuntimeError(f"{name}() requires a path argument, got {kind(t) if isinstance(b, Val) else 'entity'}")
        own = lookup(name)
        if own is None:
            raise CypherRuntimeError(f"Function '{e.name}' is not yet supported")
        function, returns = own
        return Val(function(*[self.value(a, scope).col for a in e.args]), T.DataType.fromDDL(returns))


def entity_value(b: Node | Edge) -> Val:
    props = T.StructType([T.StructField(k, t) for k, (_, t) in sorted(b.props.items())] or [T.StructField("_", STR)])
    names = [("id", STR), ("labels", T.ArrayType(STR))] if isinstance(b, Node) else [("id", STR), ("sourceId", STR), ("targetId", STR), ("type", STR)]
    return Val(b.struct(), T.StructType([T.StructField(n, t) for n, t in names] + [T.StructField("properties", props)]))


def column(name: str) -> Column:
    return F.col(quoted(name))
