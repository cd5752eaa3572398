"""All registered queries of the regatta operators, with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..adapters import Tables, duckdb_ctes

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name; sql may use every domain table and begin with WITH."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            recursive = body.startswith("WITH RECURSIVE")
            body = body.removeprefix("WITH RECURSIVE").removeprefix("WITH")
            _SQL[name] = f"WITH {'RECURSIVE ' * recursive}{duckdb_ctes()}{',' if body != sql.strip() else ''}\n{body}"
        return f

    return add


def flagship(spark, sf_dir):
    return queries()["agg_1_year_speeds_normalized"](spark, sf_dir)


def _load() -> None:
    from . import aggregations, audits, competitions, digesting, expressions, filtering, ingest, joining, merging, quality  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
