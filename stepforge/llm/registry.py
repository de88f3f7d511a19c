"""Queries of this subpackage, gathered from its operator modules."""

from __future__ import annotations

import importlib

MODULES = ["telephony", "packing", "chat", "simhash", "decontamination", "ppm", "language_id", "secrets", "pii", "substring_dedup", "merkle", "vector_codes", "mixing"]


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
