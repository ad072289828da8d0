"""Queries by name, with their DuckDB statements. Modules register theirs on import."""

from __future__ import annotations

from storyloom.registry import ORACLE, QUERIES
from storyloom.operators import dictionary, embeddings, events, filters, partials, rollups, scoring, selection, similarity, upserts  # noqa: F401  registering their queries
from storyloom.plans import desk, homepage, products  # noqa: F401
from storyloom.sources import pages  # noqa: F401
from storyloom.streaming import ingest, jobs  # noqa: F401


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["QUERIES", "oracle_sql"]
