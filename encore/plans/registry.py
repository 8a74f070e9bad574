"""Everything the driver contract asks for."""

from __future__ import annotations

from ..oracle import cohorts_sql, grain_sql, models_sql, sources_sql, trips_sql
from ..oracle.build import SqlLibrary
from ..oracle.rounding import DOUBLES
from . import results_trips, results_grain, results_cohorts, results_models, results_sources  # noqa: F401,I001
from .catalog import CATALOG, callables

LIBRARY = SqlLibrary(sources_sql, trips_sql, grain_sql, cohorts_sql, models_sql)


def queries():
    return callables()


def _rounded(name: str, sql: str, places: int = 6) -> str:
    """The statement with its fractional columns rounded, as the Spark side rounds them."""
    columns = DOUBLES.get(name, [])
    if not columns:
        return sql
    changed = ", ".join(f"round({c}, {places}) + 0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({changed}) FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    return {
        name: LIBRARY.statement(_rounded(name, entry.sql)) for name, entry in CATALOG.items() if entry.sql is not None
    }
