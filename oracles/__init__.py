"""The registered queries once more, as SQL for DuckDB on the same tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["series_sql", "scalar_sql", "identity_sql", "table_sql", "writeup_sql", "search_sql", "profile_sql", "store_sql"]


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in _MODULES:
        out.update(import_module(f"oracles.{name}").SQL)
    return out
