"""Registered queries: operators applied to the test tables, with equivalent SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("matrix", "markers", "tables", "benchmarks", "sequences", "sources", "fits")


def all_queries() -> dict:
    """Every query by name."""
    from quern.plans.base import QUERIES

    for name in MODULES:
        import_module(f"quern.plans.{name}")
    return QUERIES
