"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    of: Expr
    items: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    branches: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    entries: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    name: str
    items: Expr
    where: Expr | None


@dataclass(frozen=True)
class Comprehension(Expr):
    name: str
    items: Expr
    where: Expr | None
    result: Expr | None


@dataclass(frozen=True)
class NodePattern:
    name: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class EdgePattern:
    name: str | None
    types: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]
    incoming: bool
    low: int | None = None  # set for paths of variable length
    high: int | None = None

    @property
    def variable(self) -> bool:
        return self.low is not None


@dataclass(frozen=True)
class Path:
    name: str | None
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...]


@dataclass(frozen=True)
class Exists(Expr):
    paths: tuple[Path, ...]
    where: Expr | None


@dataclass(frozen=True)
class PatternExpr(Expr):
    path: Path


@dataclass(frozen=True)
class PatternComprehension(Expr):
    path: Path
    where: Expr | None
    result: Expr


@dataclass(frozen=True, eq=False)
class Column(Expr):
    """A column that an extracted subquery has left in the rows; ``value`` is the compiled one."""

    value: Any

    def __eq__(self, other: object) -> bool:
        return self is other

    def __hash__(self) -> int:
        return id(self)


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class SortItem:
    expr: Expr
    descending: bool


@dataclass
class Match:
    paths: list[Path]
    where: Expr | None
    optional: bool


@dataclass
class Unwind:
    expr: Expr
    name: str


@dataclass
class Create:
    paths: list[Path]


@dataclass
class SetItem:
    target: str
    key: str | None
    op: str  # '=' or '+='
    value: Expr


@dataclass
class Merge:
    path: Path
    on_create: list[SetItem]
    on_match: list[SetItem]


@dataclass
class Set:
    items: list[SetItem]


@dataclass
class Delete:
    names: list[str]
    detach: bool


@dataclass
class Remove:
    items: list[tuple[str, str | None, tuple[str, ...]]]  # name, property or labels


@dataclass
class Projection:
    """WITH or RETURN."""

    items: list[Item]
    distinct: bool = False
    star: bool = False
    where: Expr | None = None
    order: list[SortItem] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass
class Segment:
    reading: list[Match | Unwind]
    writing: list[Create | Merge | Set | Delete | Remove]
    projection: Projection | None  # None: a query that only writes


@dataclass
class Query:
    segments: list[Segment]


@dataclass
class Union:
    queries: list[Query]
    all: list[bool]
    order: list[SortItem]
    skip: Expr | None
    limit: Expr | None


@dataclass
class CreateIndex:
    name: str
    target: str
    label: str | None
    keys: list[str]


@dataclass
class DropIndex:
    name: str


@dataclass
class ShowIndexes:
    pass


def children(x: Any) -> list[Any]:
    """Direct sub-expressions, those in patterns included."""
    if isinstance(x, (Prop, Unary, IsNull)):
        return [x.of]
    if isinstance(x, Binary):
        return [x.left, x.right]
    if isinstance(x, InList):
        return [x.of, x.items]
    if isinstance(x, Case):
        return [y for y in (x.subject, *(z for b in x.branches for z in b), x.default) if y is not None]
    if isinstance(x, ListOf):
        return list(x.items)
    if isinstance(x, MapOf):
        return [v for _, v in x.entries]
    if isinstance(x, Call):
        return list(x.args)
    if isinstance(x, Quantifier):
        return [y for y in (x.items, x.where) if y is not None]
    if isinstance(x, Comprehension):
        return [y for y in (x.items, x.where, x.result) if y is not None]
    if isinstance(x, Exists):
        return [y for p in x.paths for y in pattern_exprs(p)] + ([x.where] if x.where else [])
    if isinstance(x, PatternExpr):
        return pattern_exprs(x.path)
    if isinstance(x, PatternComprehension):
        return pattern_exprs(x.path) + [y for y in (x.where, x.result) if y is not None]
    return []


def pattern_exprs(path: Path) -> list[Expr]:
    return [v for part in (*path.nodes, *path.edges) for _, v in part.props]


def pattern_names(path: Path) -> list[str]:
    return [p.name for p in (*path.nodes, *path.edges) if p.name]


def rewrite(x: Any, change: Any) -> Any:
    """``x`` with ``change`` applied to every node from the top; a node that change() replaces is not descended into."""
    new = change(x)
    if new is not None:
        return new
    go = lambda y: rewrite(y, change) if isinstance(y, Expr) else y
    if isinstance(x, Prop):
        return Prop(go(x.of), x.key)
    if isinstance(x, Unary):
        return Unary(x.op, go(x.of))
    if isinstance(x, IsNull):
        return IsNull(go(x.of), x.negated)
    if isinstance(x, Binary):
        return Binary(x.op, go(x.left), go(x.right))
    if isinstance(x, InList):
        return InList(go(x.of), go(x.items), x.negated)
    if isinstance(x, Case):
        return Case(go(x.subject), tuple((go(a), go(b)) for a, b in x.branches), go(x.default))
    if isinstance(x, ListOf):
        return ListOf(tuple(go(y) for y in x.items))
    if isinstance(x, MapOf):
        return MapOf(tuple((k, go(v)) for k, v in x.entries))
    if isinstance(x, Call):
        return Call(x.name, tuple(go(y) for y in x.args), x.distinct, x.star)
    if isinstance(x, Quantifier):
        return Quantifier(x.kind, x.name, go(x.items), go(x.where))
    if isinstance(x, Comprehension):
        return Comprehension(x.name, go(x.items), go(x.where), go(x.result))
    return x


def walk(x: Any):
    yield x
    for y in children(x):
        yield from walk(y)
