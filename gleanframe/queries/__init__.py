"""Registered queries with their DuckDB counterparts, grouped by subject.

Each module holds ``QUERIES`` (name to callable) and ``ORACLES`` (name to SQL).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["text", "profiles", "records", "tracking", "charting", "bundles", "corpus"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
