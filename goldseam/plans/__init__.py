"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "goldset", "indexes", "screening", "lanes", "reports")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"goldseam.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
