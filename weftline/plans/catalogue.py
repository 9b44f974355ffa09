"""All queries by name, and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import evaluation_queries, graph_queries, model_queries, source_queries, text_queries, vector_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
