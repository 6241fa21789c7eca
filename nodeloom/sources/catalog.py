"""The property graph as tables: node tables by label and edge tables by type.

A table belongs to an id *space*. Ids are native columns inside a space, so joins between an edge table and the node
table at its end compare the key columns as they are stored. Where a pattern spans several spaces, and for ``id()``,
an id takes its global form ``space:key``. Graphs built through the API have the one space ``""`` and string ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_META = ("_id", "_labels", "createdOn", "updatedOn")
EDGE_META = ("_id", "_src", "_dst", "_type", "createdOn", "updatedOn")


class _Table:
    """What a table holds: a DataFrame, or a function that opens it when a query first names the table."""

    source: DataFrame | Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()


@dataclass(frozen=True)
class NodeTable(_Table):
    """``df`` has ``_id`` and property columns; ``labels`` None: a column ``_labels`` holds each node's labels."""

    source: DataFrame | Callable[[], DataFrame]
    labels: tuple[str, ...] | None
    space: str = ""

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in NODE_META]


@dataclass(frozen=True)
class EdgeTable(_Table):
    """``df`` has ``_id``, ``_src``, ``_dst`` and property columns; ``type`` None: a column ``_type`` holds the type.

    ``unique`` names the ends ("src", "dst") at which a node has one edge of the table at most.
    """

    source: DataFrame | Callable[[], DataFrame]
    type: str | None
    src_space: str = ""
    dst_space: str = ""
    src_labels: tuple[str, ...] | None = None
    dst_labels: tuple[str, ...] | None = None
    unique: tuple[str, ...] = ()

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in EDGE_META]


@dataclass(frozen=True)
class Catalog:
    """``complete``: every edge's ends exist, so a pattern's end need not be looked up just to see that it is there."""

    nodes: tuple[NodeTable, ...]
    edges: tuple[EdgeTable, ...]
    complete: bool = False

    def node_tables(self, labels: Iterable[str], space: str | None = None) -> list[NodeTable]:
        wanted = set(labels)
        fits = [t for t in self.nodes if t.labels is None or not wanted or wanted & set(t.labels)]
        return [t for t in fits if space is None or t.space == space]

    def edge_tables(self, types: Iterable[str]) -> list[EdgeTable]:
        wanted = set(types)
        return [t for t in self.edges if t.type is None or not wanted or t.type in wanted]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def global_id(col: Column, space: str | None) -> Column:
    """``space:key``, or the bare key in the space without a name; None: it already is."""
    if space is None or space == "":
        return col.cast("string")
    return F.concat(F.lit(f"{space}:"), col.cast("string"))
