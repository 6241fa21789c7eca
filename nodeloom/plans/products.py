"""Counts over pairs of two patterns that share no variable, without making the pairs.

``MATCH (a), (b) WHERE a.k = b.k AND a.v < b.v RETURN b.name, count(*)`` has as many pairs as the product of its sides, but
asks of them only how many there are for each row of one side. That number is a sum over the other side's rows with the
same keys and smaller values: running sums over both sides' distinct values, in blocks of values, so that neither a
frequent key nor the lack of one puts all rows into one task (strings: by keys only).
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.functions.expressions import Edge, Node, Val, is_num, is_str
from nodeloom.plans import syntax as s
from nodeloom.plans.parser import is_aggregate

if TYPE_CHECKING:
    from nodeloom.plans.compiler import Compiler, Rows

BLOCKS = 256
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _names(x: Any) -> set[str] | None:
    """Variables of an expression; None: it holds a pattern."""
    if isinstance(x, (s.Exists, s.PatternExpr, s.PatternComprehension)):
        return None
    out = {x.name} if isinstance(x, s.Var) else set()
    for y in s.children(x):
        more = _names(y)
        if more is None:
            return None
        out |= more
    return out


def _sides(paths: list[s.Path]) -> list[tuple[set[str], list[s.Path]]]:
    """Paths by what their variables connect."""
    out: list[tuple[set[str], list[s.Path]]] = []
    for p in paths:
        names, own = set(s.pattern_names(p)), [p]
        for x in [x for x in out if x[0] & names]:
            out.remove(x)
            names, own = names | x[0], x[1] + own
        out.append((names, own))
    return out


def _counts(p: s.Projection) -> list[s.Expr] | None:
    """What the projection reads besides count(*); None: another aggregate, or none at all."""
    rest: list[s.Expr] = []
    found = False

    def look(x: Any) -> Any:
        nonlocal found
        if is_aggregate(x):
            if x.name.lower() != "count" or x.distinct or not x.star:
                rest.append(s.Exists((), None))  # not to be counted here
            found = True
            return s.Lit(0)
        return None

    for e in (*(i.expr for i in p.items), *(o.expr for o in p.order)):
        rest.append(s.rewrite(e, look))
    return rest if found and not p.star and not p.distinct else None


def _alike(a: Val, b: Val) -> tuple[Column, Column, T.DataType] | None:
    """Both in the type in which they are compared."""
    if a.type is None or b.type is None:
        return None
    if is_num(a.type) and is_num(b.type) and not isinstance(a.type, T.DecimalType) and not isinstance(b.type, T.DecimalType):
        whole = isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType)
        # -0.0 becomes 0.0: they are equal
        return (a.col.cast("long"), b.col.cast("long"), T.LongType()) if whole else (a.col.cast("double") + 0.0, b.col.cast("double") + 0.0, T.DoubleType())
    if a.type == b.type and (is_str(a.type) or isinstance(a.type, (T.BooleanType, T.DateType, T.TimestampType))):
        return a.col, b.col, a.type
    return None


def counted(c: Compiler, segment: s.Segment) -> tuple[Rows, str] | None:
    """Rows of the side that the projection reads and the column with how many pairs each is in; None: not such a query."""
    from nodeloom.plans.compiler import Rows, as_predicate, conjuncts

    p = segment.projection
    if p is None or segment.writing or c.trace is not None or not all(isinstance(x, s.Match) and not x.optional for x in segment.reading):
        return None
    paths = [x for m in segment.reading for x in m.paths]
    sides = _sides(paths)
    rest = _counts(p)
    if len(sides) != 2 or rest is None or any(x.name for x in paths):
        return None
    (names_a, _), (names_b, _) = sides
    for names, own in sides:
        if not all((used := _names(e)) is not None and used <= names for x in own for e in s.pattern_exprs(x)):
            return None
    read: set[str] = set()
    aliases = {i.alias for i in p.items if i.alias}
    for e in rest:
        used = _names(e)
        if used is None:
            return None
        read |= used
    read -= aliases - names_a - names_b
    if not read <= names_a and not read <= names_b:
        return None
    here, there = (0, 1) if read <= names_a else (1, 0)
    own_parts: list[list[s.Expr]] = [[], []]
    equal: list[tuple[s.Expr, s.Expr]] = []
    order: list[tuple[str, s.Expr, s.Expr]] = []
    for part in [x for m in segment.reading for x in conjuncts(as_predicate(m.where) if m.where is not None else None)]:
        used = _names(part)
        if used is None or any(is_aggregate(x) for x in s.walk(part)) or not used <= names_a | names_b:
            return None
        fits = [k for k in (0, 1) if used <= sides[k][0]]
        if fits:
            own_parts[fits[0]].append(part)
            continue
        if not isinstance(part, s.Binary) or part.op not in ("=", *_TURNED):
            return None
        left, right = _names(part.left) or set(), _names(part.right) or set()
        if left and right and left <= sides[there][0] and right <= sides[here][0]:
            op, far, near = part.op, part.left, part.right
        elif left and right and left <= sides[here][0] and right <= sides[there][0]:
            op, far, near = _TURNED.get(part.op, "="), part.right, part.left
        else:
            return None
        if op == "=":
            equal.append((far, near))
        else:
            order.append((op, far, near))
    if len(order) > 1:
        return None
    rows = [c.reading(c.unit(), [s.Match(own, reduce(lambda x, y: s.Binary("AND", x, y), parts) if parts else None, False)]) for (_, own), parts in zip(sides, own_parts, strict=True)]
    near_rows, far_rows = rows[here], rows[there]
    alike = []
    for far, near in [*equal, *(x[1:] for x in order)]:
        values = [c.exprs.compile(far, far_rows.scope), c.exprs.compile(near, near_rows.scope)]
        both = None if any(isinstance(v, (Node, Edge)) for v in values) else _alike(*values)
        if both is None:
            return None
        alike.append(both)
    keys = [c._name("key") for _ in equal]
    w = c._name("pairs")
    far_df, near_df = c._frame(far_rows), c._frame(near_rows)
    far_keys = [x.alias(k) for (x, _, _), k in zip(alike, keys, strict=False)]
    near_keys = {k: x for (_, x, _), k in zip(alike, keys, strict=False)}
    near_df = near_df.withColumns(near_keys) if near_keys else near_df
    if not order:
        totals = far_df.select(*far_keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(w)) if keys else far_df.agg(F.count(F.lit(1)).alias(w))
        out = _joined(c, near_df, totals, keys, None) if keys else near_df.crossJoin(totals)
    else:
        v = c._name("value")
        far_v, near_v, kind = alike[-1]
        near_df = near_df.withColumn(v, near_v)
        known = F.col(v).isNotNull() & ~F.isnan(v) if isinstance(kind, T.DoubleType) else F.col(v).isNotNull()
        near_df = near_df.where(known)
        held = far_df.select(*far_keys, far_v.alias(v)).where(known).groupBy(*keys, v).agg(F.count(F.lit(1)).alias(w))
        out = _joined(c, near_df, _running(c, held, near_df.select(*keys, v).distinct(), keys, v, w, order[0][0], is_num(kind)), keys, v)
    return Rows(out.where(F.col(w) > 0), near_rows.scope), w


def _joined(c: Compiler, df: DataFrame, other: DataFrame, keys: list[str], v: str | None) -> DataFrame:
    """Keys are equal where both are null."""
    names = {k: c._name("o") for k in [*keys, *([v] if v else [])]}
    cond = [F.col(k) == F.col(o) if k == v else F.col(k).eqNullSafe(F.col(o)) for k, o in names.items()]
    return df.join(other.withColumnsRenamed(names), reduce(lambda a, b: a & b, cond)).drop(*names.values())


def _running(c: Compiler, held: DataFrame, asked: DataFrame, keys: list[str], v: str, w: str, op: str, number: bool) -> DataFrame:
    """For each of ``asked``: how many rows (``w`` of each of ``held``) have the same keys and a value that is ``op`` its own."""
    turn, block, lo, hi, before = (c._name(x) for x in ("turn", "block", "lo", "hi", "before"))
    first, second = (1, 0) if op in ("<", ">") else (0, 1)  # of equal values: the asked one comes first if they don't count
    points = held.withColumn(turn, F.lit(first)).unionByName(asked.withColumn(w, F.lit(0).cast("long")).withColumn(turn, F.lit(second)))
    down = op in (">", ">=")
    if number:
        x = F.col(v).cast("double")
        ends = held.groupBy(*keys).agg(F.min(x).alias(lo), F.max(x).alias(hi))
        points = _joined(c, points, ends, keys, None) if keys else points.crossJoin(ends)
        width = F.col(hi) - F.col(lo)
        place = F.least(F.greatest((x - F.col(lo)) / width, F.lit(0.0)), F.lit(1.0))
        points = points.withColumn(block, F.when((width > 0) & (width < float("inf")), F.floor(place * (BLOCKS - 1))).otherwise(0).cast("int"))
    else:
        points = points.withColumn(block, F.lit(0))
    by = lambda name: F.col(name).desc() if down else F.col(name).asc()
    inside = Window.partitionBy(*keys, block).orderBy(by(v), F.col(turn)).rowsBetween(Window.unboundedPreceding, 0)
    blocks = points.groupBy(*keys, block).agg(F.sum(w).alias(w))
    blocks = blocks.select(*keys, block, F.coalesce(F.sum(w).over(Window.partitionBy(*keys).orderBy(by(block)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    sums = points.withColumn(w, F.sum(w).over(inside)).where(F.col(turn) == second)
    return _joined(c, sums, blocks, keys, block).select(*keys, v, (F.col(w) + F.col(before)).alias(w))
