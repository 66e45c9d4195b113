"""Registry of the query suite: one Spark builder and its DuckDB SQL per key.

The SQL is written independently against the raw tables (DuckDB views with
the table names); it shares no code with the Spark side.
"""
from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all():
    # importing the suites fills the registry
    from . import graph_suite, profile_suite, quality_suite  # noqa: F401
    from . import governance_suite, semantic_suite, catalog_suite  # noqa: F401
    from . import lineage_suite, assurance_suite, store_suite  # noqa: F401
    return QUERIES, ORACLE
