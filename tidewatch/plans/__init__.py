"""The registered queries of the library, and their SQL for DuckDB."""

from __future__ import annotations

from tidewatch.plans import behaviour, casework, context, detection, evidence, response, risk

MODULES = [detection, behaviour, response, context, casework, evidence, risk]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
