"""The register of queries: a name, a function of (spark, sf_dir), and its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.sources.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, tables: str, build: Callable[..., DataFrame], sql: str | None = None, needs: str | None = None) -> None:
    """build gets the tables (landed or derived, by name) as DataFrames; sql may use the derived views in `tables` or `needs`."""
    names = tables.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*(view(spark, sf_dir, t) for t in names))

    QUERIES[name] = query
    if sql is not None:
        wanted = [t for t in (needs if needs is not None else tables).split() if t.startswith(("v_", "star_"))]
        ORACLE[name] = duck(" ".join(wanted), sql)
