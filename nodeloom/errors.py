"""Errors of the graph, its queries and its transactions."""

from __future__ import annotations


class GraphError(Exception):
    pass


class NodeAlreadyExistsError(GraphError):
    pass


class EdgeAlreadyExistsError(GraphError):
    pass


class NodeNotFoundError(GraphError):
    pass


class EdgeNotFoundError(GraphError):
    pass


class NodeHasEdgesError(GraphError):
    pass


class TraversalLimitExceededError(GraphError):
    pass


class InvalidGraphDataError(GraphError):
    pass


class InvalidPropertyError(GraphError):
    pass


class TransactionConflictError(GraphError):
    pass


class TransactionNotActiveError(GraphError):
    pass


class TransactionFailedError(GraphError):
    pass


class CypherError(Exception):
    pass


class CypherSyntaxError(CypherError):
    def __init__(self, message: str, line: int = 1, column: int = 1) -> None:
        super().__init__(f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class CypherNotSupportedError(CypherError):
    pass


class CypherSemanticError(CypherError):
    pass


class CypherRuntimeError(CypherError):
    pass


class UnboundParameterError(CypherRuntimeError):
    pass


class TypeMismatchError(CypherRuntimeError):
    pass
