"""Name to query, and name to the same query in DuckDB SQL."""

from __future__ import annotations

from . import document_queries, mesh_queries, scalar_queries, spatial_queries, statistics_queries  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
