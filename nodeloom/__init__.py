"""A property-graph analytics engine on PySpark."""

from nodeloom.graph import Graph, GraphManager, Index, QueryResult, Transaction

__all__ = ["Graph", "GraphManager", "Index", "QueryResult", "Transaction"]
