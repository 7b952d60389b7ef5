"""Registered queries over the engine's own operators."""

from __future__ import annotations

import importlib

_MODULES = ("relational", "models", "more")


def _books() -> list:
    return [importlib.import_module(f"{__name__}.{m}").book for m in _MODULES]


def queries() -> dict:
    return {k: v for b in _books() for k, v in b.queries.items()}


def oracle_sql() -> dict:
    return {k: v for b in _books() for k, v in b.sql.items()}
