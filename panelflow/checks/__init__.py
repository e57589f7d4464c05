"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ["regions", "texts", "translation", "reports", "catalog", "jobs", "exports", "streams", "changes", "memory", "files"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"panelflow.checks.{name}")


def all_queries() -> dict:
    from panelflow.checks.base import QUERIES
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from panelflow.checks.base import SQL
    _load()
    return dict(SQL)
