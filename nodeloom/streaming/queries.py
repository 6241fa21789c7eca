"""Reading queries over streams.

A statement whose clauses are one pattern node, WHERE and RETURN is stateless, so the compiler's DataFrame works over a
streaming table as it does over a static one: register the stream as a node table and run the query.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from nodeloom.errors import CypherNotSupportedError
from nodeloom.graph import parsed
from nodeloom.plans import syntax as s
from nodeloom.plans.compiler import Compiler
from nodeloom.plans.parser import has_aggregate
from nodeloom.sources.catalog import Catalog, NodeTable


def stream_query(nodes: DataFrame, label: str, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """``text`` over the stream ``nodes`` (column _id and properties) as the only table, with the label ``label``."""
    q = parsed(text)
    stateless = isinstance(q, s.Query) and all(
        not g.writing and all(isinstance(c, s.Unwind) or not c.optional and all(not p.edges for p in c.paths) for c in g.reading) and g.projection is not None and not (g.projection.order or g.projection.skip or g.projection.limit or g.projection.distinct or any(has_aggregate(i.expr) for i in g.projection.items))
        for g in q.segments
    )
    if not stateless or sum(isinstance(c, s.Match) for g in q.segments for c in g.reading) != 1:
        raise CypherNotSupportedError("Only scans, filters, UNWIND and projections run over streams")
    return Compiler(nodes.sparkSession, Catalog((NodeTable(nodes, (label,), label),), (), complete=True), params).query(q)
