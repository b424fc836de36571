"""All registered queries by key."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["evidence_queries", "extraction_queries", "analytics_queries", "evaluation_queries", "model_queries", "training_queries", "ontology_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out.update(import_module(f"hazardloom.plans.{name}").QUERIES)
    return out
