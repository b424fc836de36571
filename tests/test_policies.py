"""Decision chains at, just below and just above each threshold."""

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import triage

POLICY = [
    (0.90, 0, 0, 0, 0, "P1", "VERY_HIGH_MODEL_SCORE"),
    (0.90 - 1e-9, 0, 0, 0, 0, "P2", "HIGH_MODEL_SCORE_REVIEW"),
    (0.75, 1, 1, 1, 1, "P1", "HIGH_MODEL_PLUS_COMPLETE_PATHWAY"),
    (0.75, 0, 0, 0, 0, "P2", "HIGH_MODEL_SCORE_REVIEW"),
    (0.75 - 1e-9, 1, 1, 1, 1, "P2", "MODERATE_HIGH_MODEL_PLUS_EXPLICIT_MECHANISM"),
    (0.50, 0, 1, 0, 0, "P2", "MODERATE_HIGH_MODEL_PLUS_EXPLICIT_MECHANISM"),
    (0.50, 1, 0, 0, 0, "P3", "MODERATE_MODEL_SCORE"),
    (0.50 - 1e-9, 1, 1, 1, 1, "P1", "MODEL_MISS_PLUS_COMPLETE_PATHWAY"),
    (0.30, 1, 0, 0, 0, "P3", "LOWER_MODEL_PLUS_PRECURSOR_SIGNAL"),
    (0.30 - 1e-9, 1, 0, 0, 0, "P4", "LOW_MODEL_PLUS_PRECURSOR_SIGNAL"),
    (0.0, 0, 0, 0, 0, "P5", "LOW_MODEL_NO_PRECURSOR_SIGNAL"),
]


def test_current_policy(spark):
    rows = [(i, *r) for i, r in enumerate(POLICY)]
    cols = ["i", "p", "hazard_signal", "exposure_signal", "pathway_signal", "complete_pathway", "want", "why"]
    out = triage.priority_v14(spark.createDataFrame(rows, cols)).orderBy("i").collect()
    assert [(r.review_priority, r.review_priority_reason) for r in out] == [(r.want, r.why) for r in out]


def test_signals_are_read_leniently(spark):
    df = spark.createDataFrame([(0.1, "x", None, "0", "1")], "p double, hazard_signal string, exposure_signal string, pathway_signal string, complete_pathway string")
    assert triage.priority_v14(df).first().review_priority == "P1"


@pytest.mark.parametrize(
    "p, label, path, exp, want",
    [
        (0.75, 0, 0, 0, "HIGH_SCORE_FALSE_POSITIVE"), (0.5, 0, 0, 0, "FALSE_POSITIVE"), (0.49, 1, 1, 1, "FALSE_NEGATIVE_WITH_EVIDENCE"),
        (0.49, 1, 1, 0, "FALSE_NEGATIVE"), (0.9, None, 1, 1, "NONE"), (0.9, 1, 1, 1, "NONE"),
    ],
)
def test_conflicts(spark, p, label, path, exp, want):
    df = spark.createDataFrame([(p, label, 1, exp, path, 0)], "p double, y int, hazard_signal int, exposure_signal int, pathway_signal int, complete_pathway int")
    assert df.select(triage.conflict_type(F.col("p"), F.col("y")).alias("c")).first().c == want


def test_full_strength_against_context_is_not_supported(spark):
    from hazardloom.operators.tagging import evidence_v15_tags

    text = "Operator touched the energized cable and received an electric shock, no personnel were affected."
    row = evidence_v15_tags(spark.createDataFrame([("a", text)], ["report_id", "description"])).first()
    assert (row.pathway_signal_strength, row.sif_context_status, row.pathway_assessment) == (3, "CONTEXT_AGAINST_SIF", "NONE")
