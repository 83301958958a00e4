"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["decontaminate", "pii", "warc", "exact", "substring", "simhash", "quality", "language", "bpe", "secrets"]


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"quadrille.llm.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
