"""Registered queries against their DuckDB oracles; all of them with HAZARDLOOM_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = os.environ.get("HAZARDLOOM_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = [
    "evidence_v15_terms", "evidence_v13", "pathway_features", "triage_v14", "lsr_candidates", "extract_v04", "extract_v06",
    "reasoning_v02", "review_queue", "overview", "density_activity", "review_stats", "duplicate_group_ids", "annotation_pool",
    "annotation_violations", "resolve_labels", "quality_report", "evidence_spans", "pathway_inspection", "features_v02",
    "select_gold_set", "select_calibration_03", "select_active_batch", "average_precision", "threshold_search_oof",
    "threshold_table", "group_folds", "bootstrap_ci", "group_safe_split", "tier_metrics", "audit_hints", "sentence_offsets",
    "number_near_cue", "stream_triage", "stream_latest_review",
]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("key", list(QUERIES) if os.environ.get("HAZARDLOOM_ALL") else CORE)
def test_matches_oracle(spark, key):
    ok, message = compare(spark, duck(SF), key, QUERIES[key], ORACLES.get(key), SF)
    assert ok, message


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_entry_runs(spark):
    assert "review_priority" in entry.entry(spark).columns
