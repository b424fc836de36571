"""The corpus operators as queries over whole tables, and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and module; a module has query(spark, sf_dir) and may have ORACLE_SQL.
MODULES = {
    "op1_lm_scoring": "lm_scoring",
    "op2_quality_classifier": "quality_classifier",
    "op3_ngram_join": "ngram_join",
    "op4_byte_bpe": "byte_bpe",
    "op5_quality_rules": "quality_rules",
    "op6_decontamination": "decontamination",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_token_output": "token_output",
    "op9_language_id": "language_id",
    "op10_license_scan": "license_scan",
    "op11_importance_resampling": "importance_resampling",
    "op12_source_mixing": "source_mixing",
    "op13_token_alignment": "token_alignment",
}


#: Bytes of an Arrow batch: whole texts can be long, and several batches are in memory at once.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: in_small_batches(import_module(f"hazardloom.llm.{module}").query) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    texts = {name: getattr(import_module(f"hazardloom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in texts.items() if sql}
