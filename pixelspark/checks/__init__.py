"""Checks of every operator on the given tables."""

from . import aggregates, joins, plans, scalars, sources, windows  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
