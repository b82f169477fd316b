"""All registered queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def load() -> None:
    """Import the modules that register queries."""
    from gavelflow.plans import ALL  # noqa: F401


load()
