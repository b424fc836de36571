"""Annotation against extraction: hints, recall and miss tables per family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.matching import staged
from hazardloom.functions.text import clean_or_empty, first_token_set, share, token_recall, token_set

FAMILIES = {"hazards": "hazard_evidence", "exposures": "exposure_evidence", "consequences": "consequence_evidence", "barriers": "barrier_evidence"}


def audit_hint(human: Column, found: Column, evidence: Column, recall: Column) -> Column:
    """Current hint from presence and token recall."""
    hp, ep = human != "", found != ""
    return (
        F.when(hp & ~ep, "MISSED_CATEGORY").when(~hp & ep, "POSSIBLE_FALSE_POSITIVE").when(~hp & ~ep, "NO_SIGNAL")
        .when(recall >= 0.50, "REASONABLE_LEXICAL_OVERLAP").when(recall > 0, "PARTIAL_COVERAGE")
        .when(evidence != "", "CATEGORY_PRESENT_BUT_LOW_LEXICAL_OVERLAP").otherwise("CATEGORY_PRESENT_NO_OVERLAP")
    )


def token_hint(human: Column, found: Column, by_count: bool) -> Column:
    """Older hints on token sets: by recall, or by an overlap of two tokens and a fifth of the human ones."""
    both = F.size(F.array_intersect(human, found))
    n, m = F.size(human), F.size(found)
    head = F.when((n == 0) & (m == 0), "NO_SIGNAL").when((n > 0) & (m == 0), "MISSED_CATEGORY").when((n == 0) & (m > 0), "POSSIBLE_FALSE_POSITIVE")
    if by_count:
        return head.when(both == 0, "LOW_SEMANTIC_OVERLAP").when(
            both < F.greatest(F.lit(2), F.floor(F.lit(0.2) * n)), "PARTIAL_COVERAGE"
        ).otherwise("REASONABLE_LEXICAL_OVERLAP")
    recall = share(both, n)
    return head.when(recall >= 0.50, "REASONABLE_LEXICAL_OVERLAP").when(recall > 0, "PARTIAL_COVERAGE").otherwise("LOW_SEMANTIC_OVERLAP")


def audit_rows(notes: DataFrame, flat: DataFrame) -> DataFrame:
    """Long audit, one row per report and family, from human notes (<family>_notes) and a flat extraction."""
    joined = notes.join(flat, "report_id")
    entries = [
        F.struct(
            F.lit(k).alias("family"), clean_or_empty(F.col(f"{k}_notes")).alias("human"),
            clean_or_empty(F.col(k)).alias("found"), clean_or_empty(F.col(e)).alias("evidence"),
        )
        for k, e in FAMILIES.items()
    ]
    long = joined.select("report_id", F.explode(F.array(*entries)).alias("x")).select("report_id", "x.*")
    sets = long.withColumns({"_h": staged(token_set(F.col("human"))), "_f": staged(token_set(F.col("found")))})
    return (
        sets.withColumn("token_recall", F.round(token_recall(F.col("_h"), F.col("_f")), 4))
        .withColumns(
            {
                "audit_hint": audit_hint(F.col("human"), F.col("found"), F.col("evidence"), F.col("token_recall")),
                "recall_hint": token_hint(first_token_set(F.col("human")), first_token_set(F.col("found")), False),
                "count_hint": token_hint(first_token_set(F.col("human")), first_token_set(F.col("found")), True),
            }
        )
        .drop("_h", "_f")
    )


def audit_summary(rows: DataFrame) -> DataFrame:
    hp, ep, ev = F.col("human") != "", F.col("found") != "", F.col("evidence") != ""
    return rows.groupBy("family").agg(
        F.count_if(hp).alias("human_present"), F.count_if(ep).alias("extracted_present"), F.count_if(ev).alias("evidence_present"),
        F.count_if(hp & ~ep).alias("missed_when_human_present"), F.count_if(~hp & ep).alias("possible_false_positive"),
        F.count_if(hp & ep & (F.col("token_recall") > 0)).alias("partial_or_better"),
        F.count_if(hp & ~ev).alias("evidence_missing_when_human_present"),
        F.round(100 * share(F.count_if(hp & ~ep), F.count_if(hp)), 2).alias("miss_rate_pct"),
        F.coalesce(F.round(F.avg(F.when(hp, F.col("token_recall"))), 4), F.lit(0.0)).alias("mean_token_recall"),
    )


def misses(rows: DataFrame) -> DataFrame:
    """Reports with missed families, worst first."""
    missed = rows.where((F.col("human") != "") & (F.col("found") == ""))
    names = F.array_sort(F.collect_set("family"))  # at most one entry per family
    return missed.groupBy("report_id").agg(F.count(F.lit(1)).alias("missed_count"), F.array_join(names, ", ").alias("missed_families"))
