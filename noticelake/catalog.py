"""All registered queries of the engine, with their DuckDB equivalents."""

from __future__ import annotations

from . import registry
from .queries import decisions, documents, ingest, notices, retrieval, rollups, turns  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
