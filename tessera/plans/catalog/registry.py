from __future__ import annotations

from collections.abc import Callable

from tessera.plans.sqlviews import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn`` under ``key`` with its DuckDB twin (``None``: the
    result is checked on row count only)."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql, ctes)
        return fn
    return deco


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"
