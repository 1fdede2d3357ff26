"""Registered queries: each pairs a Spark plan over the given tables with the SQL that states its result."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL

MODULES = ("sources", "clean", "features", "groups", "losses", "metrics", "calibration", "dual", "trials", "learners", "streams")


def load() -> tuple[dict, dict]:
    """``(queries, sql)`` of all modules."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(QUERIES), dict(SQL)
