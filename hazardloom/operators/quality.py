"""Validation jobs: long tables of violations, and accept/reject checks of incoming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.text import clean_or_empty, label_text

LABELS = ["YES", "NO", "UNCERTAIN"]
CONFIDENCE = ["HIGH", "MEDIUM", "LOW"]
STATUSES = ["pending", "completed"]

Rule = tuple[str, str, Column]


def violations(df: DataFrame, rules: list[Rule], id_column: str = "report_id") -> DataFrame:
    """(id, severity, rule) for every rule a row breaks; one pass, no shuffle."""
    found = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for s, n, c in rules])
    )
    return df.select(F.col(id_column), F.explode(found).alias("v")).select(id_column, "v.severity", "v.rule")


def duplicate_ids(df: DataFrame, id_column: str = "report_id") -> DataFrame:
    bad = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bad.select(id_column, F.lit("error").alias("severity"), F.lit("duplicate_id").alias("rule"))


def group_label_conflicts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one distinct label."""
    return (
        df.groupBy(group)
        .agg(F.countDistinct(label_text(F.coalesce(F.col(label), F.lit("")))).alias("labels"), F.count(F.lit(1)).alias("records"))
        .where("labels > 1")
    )


def _completed_rules(label: str, reason: str, confidence: str, who: str, when: str, evidence: str | None) -> list[Rule]:
    text = lambda c: clean_or_empty(F.col(c))
    value = F.upper(text(label))
    rules: list[Rule] = [
        ("error", "invalid_label", ~value.isin(LABELS)),
        ("error", "missing_reason", text(reason) == ""),
        ("error", "invalid_confidence", ~F.upper(text(confidence)).isin(CONFIDENCE)),
        ("warning", "missing_annotator", text(who) == ""),
        ("warning", "missing_timestamp", text(when) == ""),
    ]
    if evidence:
        rules.append(("error", "evidence_required", value.isin("YES", "UNCERTAIN") & (text(evidence) == "")))
    return rules


def _status_checked(df: DataFrame, status: str, rules: list[Rule]) -> DataFrame:
    state = F.lower(clean_or_empty(F.col(status)))
    gated = [(s, n, (state == "completed") & c) for s, n, c in rules]
    return violations(df, [("error", "invalid_status", ~state.isin(STATUSES)), *gated]).unionByName(duplicate_ids(df))


def annotation_violations(df: DataFrame) -> DataFrame:
    """Row rules on completed annotations, duplicate ids, and groups with conflicting labels (keyed by group id)."""
    rules = _completed_rules("sif_potential", "sif_reason", "annotator_confidence", "annotator_id", "annotated_at_utc", "evidence_text")
    rows = _status_checked(df, "annotation_status", rules)
    done = df.where(F.lower(clean_or_empty(F.col("annotation_status"))) == "completed")
    groups = group_label_conflicts(done, "duplicate_group_id", "sif_potential").select(
        F.col("duplicate_group_id").alias("report_id"), F.lit("error").alias("severity"), F.lit("group_label_conflict").alias("rule")
    )
    return rows.unionByName(groups)


# Defaults of fields that older gold sets lack.
GOLD_DEFAULTS = {"exposure_notes": "", "annotator_id": "", "annotated_at_utc": "", "annotation_version": "v0.1"}


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def gold_violations(df: DataFrame) -> DataFrame:
    return annotation_violations(with_defaults(df, GOLD_DEFAULTS))


def adjudication_violations(df: DataFrame) -> DataFrame:
    rules = _completed_rules("adjudication_label", "adjudication_reason", "adjudication_confidence", "adjudicator_id", "adjudicated_at_utc", None)
    return _status_checked(df, "adjudication_status", rules)


def integrity_violations(df: DataFrame, p: str = "p") -> DataFrame:
    rules: list[Rule] = [
        ("error", "blank_text", clean_or_empty(F.col("description")) == ""),
        ("error", "score_range", F.col(p).isNull() | (F.col(p) < 0) | (F.col(p) > 1)),
        ("error", "unknown_priority", ~F.col("review_priority").isin("P1", "P2", "P3", "P4", "P5")),
    ]
    return violations(df, rules).unionByName(duplicate_ids(df))


def split_input_violations(df: DataFrame) -> DataFrame:
    rules: list[Rule] = [
        ("error", "missing_group", F.col("duplicate_group_id").isNull()),
        ("error", "invalid_label", ~F.coalesce(label_text(F.col("final_sif_potential")).isin("YES", "NO"), F.lit(False))),
    ]
    return violations(df, rules).unionByName(duplicate_ids(df))


def request_violations(df: DataFrame) -> DataFrame:
    """Limits of an incoming review or report row."""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    rules: list[Rule] = [
        ("error", "text_length", (size("description") < 1) | (size("description") > 20000)),
        ("error", "unknown_decision", ~F.coalesce(F.col("decision").isin("CONFIRMED", "REJECTED", "NEEDS_MORE_INFO"), F.lit(False))),
        ("error", "reviewer_length", (size("reviewer") < 1) | (size("reviewer") > 120)),
        ("error", "note_length", size("note") > 4000),
        ("error", "id_length", ~size("report_id").between(1, 200)),
    ]
    return violations(df, rules)


BATCH_LIMIT = 500


def batch_violations(df: DataFrame, batch: str, limit: int = BATCH_LIMIT) -> DataFrame:
    """(batch, records, rule) of the request batches that hold more records than a request may; a batch without rows can't arrive."""
    return df.groupBy(F.col(batch).alias("batch")).agg(F.count(F.lit(1)).alias("records")).where(F.col("records") > limit).withColumn("rule", F.lit("batch_size"))
