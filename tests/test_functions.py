"""Scalar edges, guards, global order and skew."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardloom.banks import audits, evidence_v13, evidence_v14, evidence_v15, extraction_v04, extraction_v05, extraction_v06, pathway_features, precursors
from hazardloom.functions import matching as m
from hazardloom.functions import ordered
from hazardloom.functions import text as tx
from hazardloom.plans.tables import OUTCOMES, SETTINGS


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "value, want", [(None, ""), ("", ""), (" \t ", ""), ("A b\n\nC", "a b c"), ("ÉHOT", "éhot")],
)
def test_norm(spark, value, want):
    assert one(spark, value, tx.norm) == want


def test_word_boundary_is_unicode(spark):
    assert not one(spark, "éhot", lambda c: m.any_of(c, [r"\bhot\b"]))


def test_lists_and_ids(spark):
    assert one(spark, "a; b; ;a ", tx.split_list) == ["a", "b", "a"]
    assert one(spark, None, tx.split_list) == []
    assert one(spark, "x | nan,y", tx.tokens) == ["x", "y"]
    assert one(spark, "17.0", tx.normalise_id) == "000017"
    assert one(spark, "2016-13-15", tx.lenient_timestamp) is None
    assert one(spark, "VII", tx.level_number) is None


def test_pieces_of_barrier_status(spark):
    from hazardloom.operators.reasoning import barrier_status

    df = spark.createDataFrame([("PPE [present]; Guard [failed_or_absent]; Rope",)], ["c"])
    present, failed = barrier_status(F.col("c"))
    row = df.select(present.alias("p"), failed.alias("f")).first()
    assert (row.p, row.f) == (["PPE", "Rope"], ["Guard"])


def banks():
    for bank in (evidence_v15, evidence_v14, evidence_v13):
        for table in (bank.HAZARDS, bank.EXPOSURES, bank.CONTEXT):
            yield from (p for ps in table.values() for p in ps)
    for table in (pathway_features.HAZARDS, pathway_features.EXPOSURES, pathway_features.PATHWAYS, audits.CONTROLS, audits.GAPS):
        yield from (p for ps in table.values() for p in ps)
    for family in (*precursors.FEATURES.values(), *precursors.SPANS.values()):
        yield from (p for ps in family.values() for p in ps)
    for bank in (extraction_v04, extraction_v05, extraction_v06):
        for name in ("HAZARDS", "EXPOSURES", "BARRIERS", "ACTIVITIES"):
            yield from (p for _, p in getattr(bank, name))


def test_guards_never_hide_a_hit():
    texts = [f"{a} {b}".lower() for a in SETTINGS for b in OUTCOMES]
    for pattern in set(banks()):
        groups = m.required_words(pattern)
        for t in texts:
            if re.search(pattern, t):
                assert all(any(w in t for w in g) for g in groups), (pattern, t)


def test_hit_cap_starves_later_labels(spark):
    bank = [("A", r"\bx\d\b"), ("B", r"\by\b")]
    df = spark.createDataFrame([("x1 X1 x2 x3 y",)], ["c"])
    hits = df.select(m.collect_hits(F.col("c"), F.lower("c"), bank, 3).alias("h")).first().h
    assert [(h.label, h.evidence) for h in hits] == [("A", "x1"), ("A", "x2"), ("A", "x3")]


def test_flash_needs_fire_context(spark):
    from hazardloom.operators.extraction import extract_v04

    rows = [("a", "A flash of light was seen."), ("b", "A flash near the gas line.")]
    out = {r.report_id: r.hazards for r in extract_v04(spark.createDataFrame(rows, ["report_id", "description"])).collect()}
    assert out == {"a": "", "b": "Fire / explosion energy"}


@pytest.mark.parametrize("parts", [1, 16])
def test_global_order_with_a_hot_value(spark, parts):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(900) < 0.4, 7, rng.integers(0, 50, 900))
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(values)], ["id", "v"]).repartition(parts)
    got = {r.id: r["rank"] for r in ordered.with_row_number(df, [F.col("v"), F.col("id")]).collect()}
    assert got == {int(i): k for k, i in enumerate(np.lexsort((np.arange(900), values)), start=1)}
    running = ordered.with_running_sums(df, [F.col("v"), F.col("id")], {"cum": "v"}).collect()
    order = np.lexsort((np.arange(900), values))
    assert {r.id: r.cum for r in running} == dict(zip(order.tolist(), np.cumsum(values[order]).tolist()))
    q = ordered.exact_quantiles(df, [], "v", {"a": 0.5, "b": 0.975}).first()
    assert (q.a, q.b) == (float(np.quantile(values, 0.5)), float(np.quantile(values, 0.975)))


def test_grouped_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("b", None), ("c", 5.0), ("a", 9.0)], ["g", "v"])
    assert {r.g: r.m for r in ordered.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {"a": 4.0, "b": 2.0, "c": 5.0}


def test_keep_first_on_a_hot_key_limits_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), "id")
    out = ordered.keep_first(df, ["k"], [F.desc("id")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r.id for r in out.collect()) == [4998, 4999]


def test_duplicate_groups_brute_force(spark):
    from hazardloom.operators.preparation import duplicate_groups, numbered_groups

    texts = ["Same  text!"] * 40 + ["same text", "other", "third.", "third"]
    df = spark.createDataFrame(list(enumerate(texts)), ["id", "t"])
    assert duplicate_groups(df, "t", "id").count() == 40 + 1 + 2
    groups = {r.t: r.duplicate_group_id for r in numbered_groups(df, "t").collect()}
    assert groups == {"Same  text!": "DUP_0002", "same text": "DUP_0002", "other": "DUP_0001", "third.": "DUP_0003", "third": "DUP_0003"}


def test_empty_input(spark):
    from hazardloom.operators import evaluation, tagging

    empty = spark.createDataFrame([], "report_id string, description string, p double, truth int")
    assert tagging.evidence_v15_tags(empty).count() == 0
    assert evaluation.binary_metrics(empty, "p", "truth", 0.5).first().f2 == 0.0
    single = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "report_id string, p double, truth int")
    assert evaluation.average_precision(single, "p", "truth").first().average_precision == 1.0


def test_hot_group_join_is_whole(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = ordered.join_groups(rows, sizes, "k", "n")
    assert out.count() == 6000 and out.where("k = 0 AND n <> 2000").count() == 0
