"""Scalar functions beyond the language's own six. A query may call what is registered here; by default nothing is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

_FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {}


def register(name: str, function: Callable[..., Column], returns: str) -> None:
    """Make ``name`` callable: ``function`` maps columns to a column of Spark type ``returns`` (e.g. upper, "string")."""
    _FUNCTIONS[name.lower()] = (function, returns)


def unregister(name: str) -> None:
    _FUNCTIONS.pop(name.lower(), None)


def lookup(name: str) -> tuple[Callable[..., Column], str] | None:
    return _FUNCTIONS.get(name.lower())
