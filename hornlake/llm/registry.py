"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["exact_dedup", "sharding", "toxicity", "decontaminate", "packing", "suffix_dedup", "simhash", "line_dedup", "token_counts", "secret_scan"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").SQL.items()}
