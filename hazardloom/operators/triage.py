"""Review priorities, conflicts and interpretations as ordered decision chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.text import is_one

PRIORITIES = ["P1", "P2", "P3", "P4", "P5"]

Rule = tuple[Column, str, str]


def _decide(rules: list[Rule], last: tuple[str, str]) -> tuple[Column, Column]:
    first, second = F.lit(last[0]), F.lit(last[1])
    for condition, a, b in reversed(rules):
        first = F.when(condition, a).otherwise(first)
        second = F.when(condition, b).otherwise(second)
    return first, second


def _choose(rules: list[tuple[Column, str]], last: str) -> Column:
    out = F.lit(last)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def _signals() -> tuple[Column, Column, Column, Column]:
    return tuple(is_one(F.col(c)) for c in ("hazard_signal", "exposure_signal", "pathway_signal", "complete_pathway"))


def priority_rank(priority: Column) -> Column:
    """P1..P5 to 1..5, anything else 9."""
    position = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), priority)
    return F.when(position > 0, position).otherwise(9).cast("int")


def priority_v14(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds review_priority and review_priority_reason of the current policy."""
    hazard, exposure, pathway, complete = _signals()
    explicit = hazard | exposure | pathway
    score = F.col(p)
    priority, reason = _decide(
        [
            (score >= 0.90, "P1", "VERY_HIGH_MODEL_SCORE"),
            ((score >= 0.75) & complete, "P1", "HIGH_MODEL_PLUS_COMPLETE_PATHWAY"),
            ((score < 0.50) & complete, "P1", "MODEL_MISS_PLUS_COMPLETE_PATHWAY"),
            (score >= 0.75, "P2", "HIGH_MODEL_SCORE_REVIEW"),
            ((score >= 0.50) & (exposure | pathway), "P2", "MODERATE_HIGH_MODEL_PLUS_EXPLICIT_MECHANISM"),
            (score >= 0.50, "P3", "MODERATE_MODEL_SCORE"),
            ((score >= 0.30) & explicit, "P3", "LOWER_MODEL_PLUS_PRECURSOR_SIGNAL"),
            (explicit, "P4", "LOW_MODEL_PLUS_PRECURSOR_SIGNAL"),
        ],
        ("P5", "LOW_MODEL_NO_PRECURSOR_SIGNAL"),
    )
    return df.withColumns({"review_priority": priority, "review_priority_reason": reason})


def priority_v13(df: DataFrame, p: str = "p") -> DataFrame:
    hazard, exposure, pathway, complete = _signals()
    score = F.col(p)
    explicit = hazard | exposure | pathway
    strong = exposure | pathway | complete | (F.coalesce(F.col("pathway_signal_strength"), F.lit(0)) >= 2)
    priority, reason = _decide(
        [
            ((score >= 0.80) & strong, "P1", "HIGH_MODEL_PLUS_EXPLICIT_PRECURSOR_EVIDENCE"),
            ((score < 0.50) & complete, "P1", "LOW_MODEL_PLUS_COMPLETE_PATHWAY_REVIEW"),
            (score >= 0.75, "P2", "HIGH_MODEL_WEAK_OR_MISSING_EVIDENCE"),
            (complete, "P3", "COMPLETE_PATHWAY_REVIEW"),
            ((score >= 0.50) & explicit, "P3", "MODERATE_MODEL_PLUS_EXPLICIT_EVIDENCE"),
            (explicit, "P4", "LOW_MODEL_PLUS_SOME_PRECURSOR_SIGNAL"),
        ],
        ("P5", "LOW_MODEL_NO_PRECURSOR_EVIDENCE"),
    )
    return df.withColumns({"review_priority": priority, "review_priority_reason": reason})


def priority_v12(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds model_evidence_conflicts, review_priority and review_decision; any conflict is P1."""
    _, exposure, pathway, complete = _signals()
    score = F.col(p)
    conflicts = F.array_compact(
        F.array(
            F.when(
                (score >= 0.75) & F.col("sif_context_status").isin("UNKNOWN", "CONTEXT_LIMITED"),
                "HIGH_SCORE_MODEL_CONFLICT",
            ),
            F.when((score < 0.20) & pathway & exposure, "MODEL_MISS_WITH_EXPLICIT_EVIDENCE"),
            F.when((score < 0.50) & complete, "LOW_SCORE_MODEL_MISS_WITH_EXPLICIT_PATHWAY"),
        )
    )
    priority, decision = _decide(
        [
            (F.col("model_evidence_conflicts") != "", "P1", "HSSE_REVIEW_REQUIRED"),
            (score >= 0.80, "P2", "PRIORITIZE_FOR_HSSE_REVIEW"),
            (score >= 0.50, "P3", "PRIORITIZE_FOR_HSSE_REVIEW"),
            (complete, "P3", "PRIORITIZE_FOR_HSSE_REVIEW"),
            (F.col("pathway_signal_strength") >= 1, "P4", "LOWER_PRIORITY_RETAIN_FOR_REVIEW"),
        ],
        ("P5", "LOWER_PRIORITY_RETAIN_FOR_REVIEW"),
    )
    return df.withColumn("model_evidence_conflicts", F.array_join(conflicts, "|")).withColumns(
        {"review_priority": priority, "review_decision": decision}
    )


def conflict_type(p: Column, label: Column) -> Column:
    """Disagreement between score and 0/1 label; null labels never conflict."""
    predicted = p >= 0.50
    _, exposure, pathway, complete = _signals()
    return _choose(
        [
            ((label == 0) & predicted & (p >= 0.75), "HIGH_SCORE_FALSE_POSITIVE"),
            ((label == 0) & predicted, "FALSE_POSITIVE"),
            ((label == 1) & ~predicted & pathway & exposure, "FALSE_NEGATIVE_WITH_EVIDENCE"),
            ((label == 1) & ~predicted, "FALSE_NEGATIVE"),
            ((label == 0) & (p >= 0.75), "HIGH_SCORE_NO"),
            ((label == 1) & (p < 0.50) & complete, "LOW_SCORE_YES_WITH_EXPLICIT_PATHWAY"),
        ],
        "NONE",
    )


def evidence_priority_v15(p: Column, conflict: Column) -> Column:
    urgent = [
        "HIGH_SCORE_FALSE_POSITIVE", "HIGH_SCORE_NO", "LOW_SCORE_YES_WITH_EXPLICIT_PATHWAY",
        "FALSE_NEGATIVE_WITH_EVIDENCE",
    ]
    return _choose(
        [
            (conflict.isin(urgent), "P1"),
            (p >= 0.80, "P2"),
            (p >= 0.50, "P3"),
            (F.col("complete_pathway") == 1, "P3"),
            (F.col("pathway_signal_strength") >= 1, "P4"),
        ],
        "P5",
    )


def evidence_priority_v14(p: Column) -> Column:
    return _choose(
        [
            ((p >= 0.80) & (F.col("complete_pathway") == 1), "P1"),
            ((p >= 0.80) & (F.col("pathway_signal_strength") >= 1), "P2"),
            (p >= 0.50, "P3"),
            (p >= 0.25, "P4"),
        ],
        "P5",
    )


def evidence_priority_v13(p: Column) -> Column:
    strength = F.col("pathway_signal_strength")
    return _choose(
        [
            ((p >= 0.80) & (F.col("complete_pathway") == 1), "P1"),
            ((p >= 0.80) & (strength >= 1), "P2"),
            ((p >= 0.50) & (strength >= 1), "P3"),
            (p >= 0.25, "P4"),
        ],
        "P5",
    )


# Reviewer texts.
READING_V15 = {
    "high_no": "High model score conflicts with adjudicated NO. Review the narrative and contextual evidence; do not allow hazard/pathway signals to override adjudication.",
    "low_yes": "Model score is below 0.50 despite explicit mechanism evidence. Treat as a possible model miss and review manually.",
    "missed": "Model prediction is NO at 0.50, but the narrative contains exposure and mechanism evidence. Review as a possible missed precursor.",
    "against": "Narrative explicitly limits personnel exposure. Do not infer SIF potential from the hazard alone.",
    "limited": "Exposure/mechanism evidence exists, but available consequence context is limited. Human HSSE review is required before SIF interpretation.",
    "sufficient": "Narrative contains material hazard/exposure/mechanism evidence. This is a strong reviewer-priority signal, not an automatic SIF decision.",
    "ranked": "Model ranks the incident above the reference threshold, but narrative evidence is incomplete. Review before disposition.",
    "low": "Low model score and limited explicit pathway evidence. Retain as lower-priority unless other HSSE context indicates otherwise.",
}
READING_V14 = {
    "high_no": "High model score conflicts with adjudicated NO. Mandatory human review; evidence signals must not override the adjudication.",
    "low_yes": "Model score is below the reference threshold despite meaningful narrative evidence. Review for a possible missed precursor.",
    "SUPPORTED": "Explicit hazard, human-exposure and mechanism evidence detected. Use as a reviewer-priority signal, not an automatic SIF declaration.",
    "PARTIAL": "Partial hazard/exposure/mechanism evidence detected. Verify missing context such as severity, energy, proximity, or actual pathway.",
    "WEAK": "Limited safety-context evidence detected. Do not infer a complete SIF pathway from the available narrative.",
    "NONE": "No explicit mechanism pathway detected. Treat model output as a ranking signal requiring human context.",
}
READING_V13 = {
    "high_no": "High model score but adjudicated NO; mandatory human review. Do not infer SIF potential from hazard/pathway signals alone.",
    "low_yes": "Model score is below the reference threshold despite meaningful hazard/exposure evidence; review for possible missed precursor.",
    "SUPPORTED": "Narrative contains explicit hazard, human-exposure, and mechanism-specific pathway evidence. Human HSSE review remains required.",
    "PARTIAL": "Narrative contains partial pathway evidence. Review missing mechanism/severity context before disposition.",
    "WEAK": "Only limited safety-context evidence is present. Avoid inferring a complete SIF pathway.",
    "NONE": "No explicit pathway evidence detected by the rules. Model score should be treated as a ranking signal requiring reviewer context.",
}


def interpretation_v15(p: Column, conflict: Column) -> Column:
    status = F.col("sif_context_status")
    t = READING_V15
    return _choose(
        [
            (conflict == "HIGH_SCORE_FALSE_POSITIVE", t["high_no"]),
            (conflict == "LOW_SCORE_YES_WITH_EXPLICIT_PATHWAY", t["low_yes"]),
            (conflict == "FALSE_NEGATIVE_WITH_EVIDENCE", t["missed"]),
            (status == "CONTEXT_AGAINST_SIF", t["against"]),
            (status == "CONTEXT_LIMITED", t["limited"]),
            (status == "SUFFICIENT_CONTEXT", t["sufficient"]),
            (p >= 0.50, t["ranked"]),
        ],
        t["low"],
    )


def interpretation_by_assessment(p: Column, label: Column, texts: dict[str, str]) -> Column:
    """Older readings (texts READING_V14 or READING_V13): label conflicts first, then the assessment word."""
    word = F.col("pathway_assessment")
    return _choose(
        [
            ((label == 0) & (p >= 0.75), texts["high_no"]),
            ((label == 1) & (p < 0.50) & (F.col("pathway_signal_strength") >= 2), texts["low_yes"]),
            (word == "SUPPORTED", texts["SUPPORTED"]),
            (word == "PARTIAL", texts["PARTIAL"]),
            (word == "WEAK", texts["WEAK"]),
        ],
        texts["NONE"],
    )


INSTRUCTION = "Review narrative and validate precursor mechanism before operational action."
MANDATORY = (
    "Mandatory manual review: model is high but narrative precursor evidence was not detected. "
    "Do not treat the score as a confirmed SIF precursor."
)


def triage_v08(df: DataFrame, p: str = "p", label: str = "label_yes") -> DataFrame:
    """Tier, reason, five flags and the instruction from score bands and evidence counts."""
    score = F.col(p)
    evidence = F.col("precursor_evidence_count") > 0
    yes = F.coalesce(F.col(label), F.lit(False))
    tier, reason = _decide(
        [
            ((score >= 0.80) & evidence, "P1", "high_model_score_with_narrative_precursor_evidence"),
            (score >= 0.80, "P2", "high_model_score_but_no_precursor_evidence_mandatory_review"),
            ((score >= 0.50) & evidence, "P3", "moderate_model_score_with_narrative_precursor_evidence"),
        ],
        ("P4", "low_or_weak_model_score"),
    )
    return df.withColumns(
        {
            "triage_tier": tier,
            "triage_reason": reason,
            "flag_no_precursor_evidence": ~evidence,
            "flag_no_control_evidence": F.col("control_category_count") == 0,
            "flag_no_gap_evidence": F.col("barrier_gap_category_count") == 0,
            "flag_no_rule_evidence": F.col("rule_evidence_count") == 0,
            "flag_model_label_conflict": ((score >= 0.80) & ~yes) | ((score < 0.30) & yes),
            "review_instruction": F.when((score >= 0.80) & ~evidence, MANDATORY).otherwise(INSTRUCTION),
        }
    )


# Review type -> (rank, question).
CONFLICT_QUESTIONS = {
    "HIGH_SCORE_FALSE_POSITIVE": (1, "Check whether the narrative contains a credible SIF pathway. Identify which mechanism phrase drove the score and whether it is actually hazardous in context."),
    "HIGH_SCORE_NO_PRECURSOR_EVIDENCE": (2, "Check why the model scored this report highly despite no detected precursor span. Inspect narrative context manually before action."),
    "LOW_SCORE_FALSE_NEGATIVE": (3, "Check whether the narrative contains a subtle precursor mechanism that the model failed to rank highly. Record the missing mechanism."),
    "NORMAL": (4, ""),
}
ADJUDICATION_FIELDS = [
    "human_precursor_decision", "human_mechanism", "human_evidence_span", "human_barrier_state",
    "human_lsr_candidate", "human_notes",
]


def conflict_review(df: DataFrame, p: str = "p", label: str = "true_label") -> DataFrame:
    """Review type (sparse evidence outranks the label conflicts), its rank and question, blank adjudication fields."""
    score, truth = F.col(p), F.col(label)
    kind = _choose(
        [
            ((score >= 0.80) & (F.col("precursor_evidence_count") == 0), "HIGH_SCORE_NO_PRECURSOR_EVIDENCE"),
            ((score < 0.50) & (truth == 1), "LOW_SCORE_FALSE_NEGATIVE"),
            ((score >= 0.80) & (truth == 0), "HIGH_SCORE_FALSE_POSITIVE"),
        ],
        "NORMAL",
    )
    typed = df.withColumn("review_type", kind)
    by_type = F.col("review_type")
    rank = F.lit(4)
    question = F.lit("")
    for name, (number, text) in CONFLICT_QUESTIONS.items():
        rank = F.when(by_type == name, number).otherwise(rank)
        question = F.when(by_type == name, text).otherwise(question)
    return typed.withColumns(
        {"review_rank": rank, "review_questions": question, **{c: F.lit("") for c in ADJUDICATION_FIELDS}}
    )


def error_type(predicted: Column, label: Column) -> Column:
    return (
        F.when(predicted == label, "CORRECT")
        .when((predicted == 1) & (label == 0), "FALSE_POSITIVE")
        .when((predicted == 0) & (label == 1), "FALSE_NEGATIVE")
    )


def prediction_record(p: str = "p") -> Column:
    """Nested record of one tagged, triaged report with rule candidates."""
    evidence = [
        "hazards", "exposures", "pathways", "hazard_evidence", "exposure_evidence", "pathway_evidence",
        "hazard_signal", "exposure_signal", "pathway_signal", "pathway_signal_strength", "complete_pathway",
        "sif_context_status", "pathway_assessment",
    ]
    return F.struct(
        F.col("report_id"),
        F.round(F.col(p), 6).alias("sif_precursor_probability"),
        (F.col(p) >= 0.5).alias("prediction_at_0_50"),
        F.struct(
            F.col("review_priority").alias("priority"),
            F.col("review_priority_reason").alias("reason"),
            F.lit(True).alias("human_review_required"),
        ).alias("review"),
        F.struct(*[F.col(c) for c in evidence]).alias("evidence"),
        F.col("rule_candidates").alias("lsr_candidates"),
        F.struct(
            F.lit("Narrative description only").alias("model_input"),
            F.lit(False).alias("autonomous_sif_decision"),
            F.lit(True).alias("requires_hsse_review"),
        ).alias("governance"),
        F.struct(
            F.lit("v1.4").alias("review_policy"), F.lit("v1.5").alias("evidence_engine"),
            F.lit("v0.5").alias("activity_metadata"),
        ).alias("versions"),
    )
