"""All oracle texts by query key."""

from __future__ import annotations

from importlib import import_module

MODULES = ["evidence", "extraction", "analytics", "evaluation", "model", "training", "ontology"]


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"oracles.{name}").oracles())
    return out
