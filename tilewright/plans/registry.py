"""All registered queries of the matrix and tensor operators."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
MODULES = ("entries", "reports", "clusters", "lowrank", "solvers", "tensors", "hierarchical")


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tilewright.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
