"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "suffixes", "urls", "topk", "bpe", "lattice", "warc", "packing", "licences", "minhash", "variants", "bestfit", "wand")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"goldseam.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
