"""The engine's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import queries_ops, queries_retrieval, queries_runs, queries_text  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
