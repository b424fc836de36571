"""Registered queries: evidence tagging, features, policies, rule candidates."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.banks import evidence_v15, rules as rule_bank
from hazardloom.functions import matching as m
from hazardloom.functions.text import binary_label, norm
from hazardloom.operators import analytics, rules, tagging, triage
from hazardloom.plans.tables import predictions, reports, stored_predictions, with_labels

SIGNALS = ["hazard_signal", "exposure_signal", "pathway_signal", "pathway_signal_strength", "complete_pathway"]
NAMES = ["hazards", "exposures", "pathways"]
EVIDENCE = ["hazard_evidence", "exposure_evidence", "pathway_evidence"]


def _narrow(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("report_id", "description")


def _text(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("report_id", norm(F.col("description")).alias("t"))


def evidence_v15_query(spark, sf):
    return tagging.evidence_v15_tags(_narrow(spark, sf)).select(
        "report_id", *NAMES, "context_flags", *SIGNALS, "sif_context_status", "sif_context_reason", "pathway_assessment"
    )


def evidence_v15_terms(spark, sf):
    return tagging.evidence_v15_tags(_narrow(spark, sf)).select(
        "report_id", *NAMES, *EVIDENCE, "minor_context", "severe_context"
    )


def evidence_v14(spark, sf):
    return tagging.evidence_v14_tags(_narrow(spark, sf)).select(
        "report_id", *NAMES, *EVIDENCE, "context_flags", *SIGNALS, "pathway_assessment"
    )


def evidence_v13(spark, sf):
    return tagging.evidence_v13_tags(_narrow(spark, sf)).select(
        "report_id", *NAMES, *EVIDENCE, "safe_context_flags", *SIGNALS, "pathway_assessment"
    )


def pathway_gating(spark, sf):
    """The current bank with a chemical gate open to every hazard, so that only the water rule holds it back."""
    b = evidence_v15
    opened = dict(b.PATHWAYS, chemical_release_exposure=("chemical_exposure", sorted(b.HAZARDS)))
    bank = SimpleNamespace(
        HAZARDS=b.HAZARDS, EXPOSURES=b.EXPOSURES, CONTEXT=b.CONTEXT, NOT_AN_EXPOSURE=b.NOT_AN_EXPOSURE, PATHWAYS=opened
    )
    return tagging.gated_pathways(_narrow(spark, sf), bank).drop("description")


def pathway_features(spark, sf):
    return tagging.pathway_feature_columns(_narrow(spark, sf)).drop("description")


def training_evidence(spark, sf):
    return tagging.training_evidence(_narrow(spark, sf)).drop("description")


def reconstructed_features(spark, sf):
    return tagging.reconstructed_features(tagging.evidence_v15_tags(_narrow(spark, sf)))


def tag_any(spark, sf):
    h = evidence_v15.HAZARDS
    t = F.col("t")
    return _text(spark, sf).select(
        "report_id", m.any_of(t, h["vehicle"]).cast("int").alias("vehicle"), m.any_of(t, h["thermal"]).cast("int").alias("thermal")
    )


def tag_first_evidence(spark, sf):
    h = evidence_v15.HAZARDS
    t = F.col("t")
    return _text(spark, sf).select(
        "report_id", m.first_hit(t, h["fall_height"]).alias("fall_evidence"), m.first_hit(t, h["chemical"]).alias("chemical_evidence")
    )


def tag_all_terms(spark, sf):
    terms = m.all_terms(F.col("t"), evidence_v15.HAZARDS["chemical"])
    return _text(spark, sf).select("report_id", F.array_join(terms, " | ").alias("chemical_terms"))


def tag_pattern_counts(spark, sf):
    return _text(spark, sf).select(
        "report_id", m.count_patterns(F.col("t"), evidence_v15.HAZARDS["chemical"]).alias("chemical_patterns")
    )


def tag_categories(spark, sf):
    hits = m.categories(F.col("t"), evidence_v15.HAZARDS)
    return _text(spark, sf).select("report_id", F.explode(m.names(hits)).alias("category"))


def triage_v14(spark, sf):
    return predictions(spark, sf).select("report_id", "p", "review_priority", "review_priority_reason")


def _tagged(spark, sf):
    return tagging.evidence_v15_tags(reports(spark, sf))


def triage_v13(spark, sf):
    return triage.priority_v13(_tagged(spark, sf)).select("report_id", "p", "review_priority", "review_priority_reason")


def triage_v12(spark, sf):
    return triage.priority_v12(_tagged(spark, sf)).select(
        "report_id", "p", "model_evidence_conflicts", "review_priority", "review_decision"
    )


def conflicted(spark, sf):
    tags = with_labels(_tagged(spark, sf).drop("description", "raw_text"), spark, sf).withColumn("y", binary_label(F.col("label")))
    return tags.withColumn("conflict_type", triage.conflict_type(F.col("p"), F.col("y")))


def evidence_priority(spark, sf):
    p = F.col("p")
    return conflicted(spark, sf).select(
        "report_id",
        triage.evidence_priority_v15(p, F.col("conflict_type")).alias("priority_v15"),
        triage.evidence_priority_v14(p).alias("priority_v14"),
        triage.evidence_priority_v13(p).alias("priority_v13"),
    )


def conflict_type(spark, sf):
    return conflicted(spark, sf).where(F.col("label").isNotNull()).select("report_id", "p", "label", "conflict_type")


def interpretation(spark, sf):
    p, y = F.col("p"), F.col("y")
    return conflicted(spark, sf).select(
        "report_id",
        triage.interpretation_v15(p, F.col("conflict_type")).alias("reading_v15"),
        triage.interpretation_by_assessment(p, y, triage.READING_V14).alias("reading_v14"),
        triage.interpretation_by_assessment(p, y, triage.READING_V13).alias("reading_v13"),
    )


def _candidates(table, sort_terms=True):
    def run(spark, sf):
        tags = tagging.evidence_v15_tags(_narrow(spark, sf))
        found = rules.rule_candidates(tags, table, sort_terms=sort_terms)
        return found.select("report_id", rules.render_candidates(F.col("rule_candidates")).alias("rule_candidates"))

    return run


def lsr_counts(spark, sf):
    return analytics.rule_counts(stored_predictions(spark, sf))


def prediction_records(spark, sf):
    rows = stored_predictions(spark, sf).select(triage.prediction_record().alias("r"))
    return rows.select(
        "r.report_id",
        F.col("r.sif_precursor_probability").alias("probability"),
        F.col("r.prediction_at_0_50").alias("flagged"),
        F.col("r.review.priority").alias("review_priority"),
        F.col("r.review.reason").alias("review_priority_reason"),
        "r.evidence.hazards", "r.evidence.exposures", "r.evidence.pathways", "r.evidence.sif_context_status",
        "r.evidence.pathway_assessment", "r.evidence.complete_pathway",
        rules.render_candidates(F.col("r.lsr_candidates")).alias("rules"),
    )


QUERIES = {
    "evidence_v15": evidence_v15_query,
    "evidence_v15_terms": evidence_v15_terms,
    "evidence_v14": evidence_v14,
    "evidence_v13": evidence_v13,
    "pathway_gating": pathway_gating,
    "pathway_features": pathway_features,
    "training_evidence": training_evidence,
    "reconstructed_features": reconstructed_features,
    "tag_any": tag_any,
    "tag_first_evidence": tag_first_evidence,
    "tag_all_terms": tag_all_terms,
    "tag_pattern_counts": tag_pattern_counts,
    "tag_categories": tag_categories,
    "triage_v14": triage_v14,
    "triage_v13": triage_v13,
    "triage_v12": triage_v12,
    "evidence_priority": evidence_priority,
    "conflict_type": conflict_type,
    "interpretation": interpretation,
    "lsr_candidates": _candidates(rule_bank.CURRENT),
    "lsr_candidates_exact": _candidates(rule_bank.EXACT),
    "lsr_candidates_v10": _candidates(rule_bank.FIRST, sort_terms=False),
    "lsr_counts": lsr_counts,
    "prediction_records": prediction_records,
}
