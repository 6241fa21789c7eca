"""Filter, order and limit options of the graph API, as DataFrame operations.

``{"filter": {"types": [...], "properties": <p>}, "order_by": [(key, "asc"|"desc")], "limit": n}`` where <p> is a
condition ``{"key", "op", "value"}``, a list of them (all must hold) or ``{"and"|"or": [<p>, ...]}``.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.errors import GraphError
from nodeloom.functions.expressions import Val, _literal, _order, equal
from nodeloom.sources.catalog import quoted

OPS = ("=", "<>", ">", "<", ">=", "<=", "CONTAINS", "STARTS_WITH", "ENDS_WITH", "IN", "NOT_IN", "IS_NULL", "IS_NOT_NULL")


def condition(df: DataFrame, p: Any) -> Column:
    if isinstance(p, (list, tuple)):
        return reduce(lambda a, b: a & b, [condition(df, x) for x in p], F.lit(True))
    for word, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in p:
            parts = [condition(df, x) for x in p[word]]
            return reduce(join, parts) if parts else F.lit(word == "and")
    key, op, value = p["key"], p.get("op", "="), p.get("value")
    if op not in OPS:
        raise GraphError(f"Unknown filter operator '{op}'")
    v = Val(F.col(quoted(key)), df.schema[key].dataType) if key in df.columns else Val(F.lit(None).cast("string"), None)
    if op == "IS_NULL":
        return v.col.isNull()
    if op == "IS_NOT_NULL":
        return v.col.isNotNull()
    if op in ("IN", "NOT_IN"):
        found = reduce(lambda a, b: a | b, [equal(v, _literal(x)) for x in value], F.lit(False))
        return found if op == "IN" else ~found
    w = _literal(value)
    if op in ("=", "<>"):
        return equal(v, w) if op == "=" else ~equal(v, w)
    if op in ("<", "<=", ">", ">="):
        return F.coalesce(_order(op, v, w).col, F.lit(False))
    if not (isinstance(value, str) and v.type is not None and v.type.typeName() == "string"):
        return F.lit(False)
    f = {"CONTAINS": F.contains, "STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith}[op]
    return F.coalesce(f(v.col, w.col), F.lit(False))


def select(df: DataFrame, options: dict[str, Any] | None, label: str) -> DataFrame:
    """``label``: '_labels' or '_type'."""
    options = options or {}
    f = options.get("filter") or {}
    types = [t for t in f.get("types") or [] if t != "*"]
    if types and label == "_labels":
        df = df.where(F.arrays_overlap(label, F.array(*[F.lit(t) for t in types])))
    elif types:
        df = df.where(F.col(label).isin(types))
    if f.get("properties"):
        df = df.where(condition(df, f["properties"]))
    order = options.get("order_by") or []
    keys = []
    for key, way in order:
        c = F.col(quoted(key)) if key in df.columns else F.lit(None)
        keys.append(c.desc_nulls_last() if way.lower() == "desc" else c.asc_nulls_first())
    if keys:
        df = df.orderBy(*keys)
    return df.limit(options["limit"]) if options.get("limit") is not None else df
