"""Registered queries over the library's tables, and the SQL they are compared with."""

from __future__ import annotations

from . import queries_exchange, queries_library, queries_maintain, queries_recommend, queries_rest

MODULES = (queries_library, queries_recommend, queries_maintain, queries_exchange, queries_rest)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.S.items()}
