"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("license_scan", "html_extract", "byte_bpe", "secret_scan", "fingerprints", "near_dup", "language_id", "toxicity", "mixing", "quality_rules", "token_alignment", "lexical_search", "packing")


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for name in MODULES:
        found |= import_module(f"orograph.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(import_module(f"orograph.llm.{name}"), "ORACLE_SQL", {})
    return found
