"""Registered queries: sentence evidence, features, selection and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.functions import text as tx
from hazardloom.operators import analytics as an
from hazardloom.operators import evaluation as ev
from hazardloom.operators import preparation as pr
from hazardloom.operators import reasoning, spans, triage
from hazardloom.operators import selection as se
from hazardloom.plans import tables as tb
from hazardloom.plans.analytics_queries import _gold
from hazardloom.plans.extraction_queries import flat_v06

OOF_GRID = [round(0.2 + 0.001 * i, 6) for i in range(601)]
FLOOR_GRID = [round(0.2 + 0.005 * i, 6) for i in range(121)]
WIDE_GRID = [round(0.005 * i, 6) for i in range(201)]
TABLE_GRID = [round(0.2 + 0.01 * i, 6) for i in range(61)]
REPEATS, FOLDS, REPS = 10, 5, 5000


def _narrow(spark, sf):
    return tb.reports(spark, sf).select("report_id", "description")


def evidence_spans(spark, sf):
    return spans.evidence_spans(_narrow(spark, sf))


def evidence_pivot(spark, sf):
    return spans.span_counts(evidence_spans(spark, sf))


def top_mechanisms(spark, sf):
    return spans.top_mechanisms(evidence_spans(spark, sf))


def barrier_audit(spark, sf):
    return spans.barrier_audit(_narrow(spark, sf)).drop("description")


def barrier_mentions(spark, sf):
    rows = barrier_audit(spark, sf)
    control, gap = F.col("control_category_count") > 0, F.col("barrier_gap_category_count") > 0
    n = F.count(F.lit(1))
    rate = lambda c: F.round(tx.share(F.count_if(c), n), 9)
    return rows.agg(
        n.alias("records"), rate(control).alias("control_mentioned_rate"), rate(gap).alias("gap_mentioned_rate"),
        rate(control & gap).alias("both_rate"), rate(~control & ~gap).alias("neither_rate"),
        F.count_if(control & ~gap).alias("control_only_count"), F.count_if(~control & gap).alias("gap_only_count"),
        F.count_if(control & gap).alias("both_count"), F.count_if(~control & ~gap).alias("neither_count"),
    )


def pathway_inspection(spark, sf):
    return spans.pathway_inspection(_narrow(spark, sf)).drop("description")


def features_v02(spark, sf):
    return spans.precursor_features(_narrow(spark, sf))


def _audited(spark, sf):
    """Gold predictions with span and mention counts; the rule candidates give the candidate count."""
    gold = _gold(spark, sf).withColumn("lsr_candidate_count", F.size("rule_candidates"))
    mentions = barrier_audit(spark, sf).select("report_id", "control_category_count", "barrier_gap_category_count")
    rows = gold.join(mentions, "report_id").withColumn("barrier_evidence_count", F.col("barrier_gap_category_count"))
    return spans.ranking_audit(rows, evidence_pivot(spark, sf))


def ranking_audit(spark, sf):
    return _audited(spark, sf).select("report_id", "p", "precursor", "barrier", "lsr", "flag_no_precursor_evidence", *spans.FLAGS, "review_score")


def flagged_cases(spark, sf):
    any_flag = reduce(lambda a, b: a | b, [F.col(c) for c in spans.FLAGS])
    return _audited(spark, sf).where(any_flag).select("report_id", "review_score")


def triage_v08(spark, sf):
    rows = _audited(spark, sf).withColumns(
        {"precursor_evidence_count": F.col("precursor"), "rule_evidence_count": F.col("lsr_candidate_count"), "label_yes": F.col("truth") == 1}
    )
    out = triage.triage_v08(rows)
    return out.select("report_id", "triage_tier", "triage_reason", "flag_no_precursor_evidence", "flag_no_control_evidence", "flag_no_gap_evidence", "flag_no_rule_evidence", "flag_model_label_conflict", "review_instruction")


def _conflicts(spark, sf):
    rows = _audited(spark, sf).withColumns({"precursor_evidence_count": F.col("precursor"), "true_label": F.col("truth")})
    return triage.conflict_review(rows)


def conflict_review(spark, sf):
    return _conflicts(spark, sf).select("report_id", "p", "review_rank", "review_type", "review_questions", "human_notes")


def conflict_summary(spark, sf):
    seen = pathway_inspection(spark, sf).select("report_id", F.col("pathway_assessment").alias("inspection"), "pathway_strength")
    rows = _conflicts(spark, sf).join(seen, "report_id")
    return rows.groupBy("review_type", "inspection").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("pathway_strength") == 3).cast("int")), 9).alias("full_pathway_rate")
    )


def error_types(spark, sf):
    return _gold(spark, sf).select("report_id", triage.error_type((F.col("p") >= 0.5).cast("int"), F.col("truth")).alias("error_type"))


def queue_enrichment(spark, sf):
    return ev.queue_enrichment(an.tier_metrics(_gold(spark, sf)))


def ranking_at_k(spark, sf):
    return ev.ranking_at_k(tb.labelled(spark, sf), "p", "truth", [5, 10, 15, 20])


def priority_quartiles(spark, sf):
    return ev.priority_quartiles(tb.reports(spark, sf).select("report_id", "p"), "p")


def _select_input(spark, sf):
    rows = tb.reports(spark, sf)
    return rows.withColumn("actual_number", tx.level_number(F.col("actual_level")))


def select_gold_set(spark, sf):
    return se.select_gold_set(_select_input(spark, sf))


def _unused(spark, sf):
    return tb.reports(spark, sf).join(tb.adjudications(spark, sf).select("report_id"), "report_id", "left_anti")


def select_calibration_02(spark, sf):
    return se.select_calibration_02(_unused(spark, sf))


def select_calibration_03(spark, sf):
    return se.select_calibration_03(_unused(spark, sf))


def select_boundary(spark, sf):
    return se.select_boundary(pr.union_completed([tb.annotations(spark, sf)]))


def active_learning_scores(spark, sf):
    rows = tb.reports(spark, sf).select("report_id", "p", "p2", "risk")
    return se.active_learning_scores(rows)


def select_active_batch(spark, sf):
    return se.select_active_batch(active_learning_scores(spark, sf)).select("report_id", "risk", "selection_reason", "active_learning_rank")


def binary_metrics(spark, sf):
    return ev.binary_metrics(tb.labelled(spark, sf), "p", "truth", 0.5)


def average_precision(spark, sf):
    return ev.average_precision(tb.labelled(spark, sf), "p", "truth")


def threshold_search_oof(spark, sf):
    return ev.best_threshold_oof(tb.labelled(spark, sf), "p", "truth", OOF_GRID)


def threshold_search_floor(spark, sf):
    return ev.best_threshold(ev.threshold_table(tb.labelled(spark, sf), "p", "truth", FLOOR_GRID))


def threshold_search_wide(spark, sf):
    return ev.best_threshold(ev.threshold_table(tb.labelled(spark, sf), "p", "truth", WIDE_GRID))


def threshold_table(spark, sf):
    return ev.threshold_table(tb.labelled(spark, sf), "p", "truth", TABLE_GRID)


def stratified_folds(spark, sf):
    return ev.stratified_folds(tb.labelled(spark, sf), "truth", FOLDS, REPEATS)


def _grouped(spark, sf):
    """Labelled reports with the group of their text; only their texts are hashed, once for all that reads the groups. Stored once."""

    def build() -> DataFrame:
        wanted = tb.load(spark, sf, "labels").where("quality is not null").select("doc_id")
        docs = tb.dealt(tb.load(spark, sf, "documents"), "doc_id").join(wanted, "doc_id", "left_semi")
        groups = pr.hashed_groups(tb.narrate(docs).select("report_id", "raw_text"), "raw_text").select("report_id", "derived_group_id")
        rows = tb.with_labels(groups, spark, sf).where(F.col("label").isNotNull())
        return rows.select("report_id", "label", (F.col("label") == "YES").cast("int").alias("truth"), F.col("derived_group_id").alias("duplicate_group_id"))

    return tb.stored_once(spark, sf, "grouped", ["documents", "labels"], build)


def group_folds(spark, sf):
    return ev.group_folds(_grouped(spark, sf), "duplicate_group_id", "truth", FOLDS, REPEATS)


def _fold_scores(spark, sf):
    """Fold scores of two models: each repeat shifts the first model's score towards the second's."""
    dealt = stratified_folds(spark, sf).join(tb.labelled(spark, sf).select("report_id", "p", "p2"), "report_id")
    models = F.array(
        F.struct(F.lit("first").alias("model"), ((F.col("p") * F.col("repeat") + F.col("p2")) / (F.col("repeat") + 1)).alias("score")),
        F.struct(F.lit("second").alias("model"), F.col("p2").alias("score")),
    )
    return dealt.select("report_id", "truth", "repeat", "fold", F.explode(models).alias("x")).select("report_id", "truth", "repeat", "fold", "x.model", "x.score")


def oof_scores(spark, sf):
    return ev.oof_scores(_fold_scores(spark, sf).where("model = 'first'"), REPEATS)


def _fold_metrics(spark, sf):
    return ev.binary_metrics(_fold_scores(spark, sf), "score", "truth", 0.5, ["model", "repeat", "fold"])


METRICS = ["accuracy", "precision", "recall", "f2"]


def fold_summary(spark, sf):
    return ev.fold_summary(_fold_metrics(spark, sf), METRICS, ["model"])


def model_deltas(spark, sf):
    return ev.model_deltas(fold_summary(spark, sf), "first")


def bootstrap_ci(spark, sf):
    return ev.bootstrap_ci(tb.labelled(spark, sf), "p", "truth", 0.5, REPS, "report_id")


def group_safe_split(spark, sf):
    return ev.group_safe_split(_grouped(spark, sf), "duplicate_group_id", "label")


def split_profile(spark, sf):
    return ev.split_profile(group_safe_split(spark, sf), "duplicate_group_id", "label")


def _naive(spark, sf):
    """A split by report id alone, which lets equal texts leak."""
    h = ev.hash_number(F.lit("naive"), F.col("report_id")) % 20
    return _grouped(spark, sf).withColumn("split", F.when(h < 14, "train").when(h < 17, "validation").otherwise("test"))


def split_leakage(spark, sf):
    return ev.split_leakage(_naive(spark, sf), ["report_id", "duplicate_group_id"])


def greedy_group_split(spark, sf):
    return ev.greedy_group_split(_grouped(spark, sf), "duplicate_group_id", "label")


def split_pair_overlap(spark, sf):
    """Groups that every two splits of the naive split share."""
    rows = _naive(spark, sf)
    return ev.pairwise_overlap({s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}, "duplicate_group_id")


def split_overlap(spark, sf):
    """Groups of the naive split by the number of splits that share them."""
    leaking = split_leakage(spark, sf).where("key = 'duplicate_group_id'")
    return leaking.groupBy("splits").agg(F.count(F.lit(1)).alias("groups"))


def unsplit_ids(spark, sf):
    return tb.reports(spark, sf).select("report_id").exceptAll(group_safe_split(spark, sf).select("report_id"))


def band_rule_eval(spark, sf):
    bands = reasoning.reasoning_v02(flat_v06(spark, sf)).select("report_id", "sif_precursor_band")
    rows = group_safe_split(spark, sf).select("report_id", "truth", "split").join(bands, "report_id")
    rules = F.array(
        F.struct(F.lit("HIGH").alias("rule"), (F.col("sif_precursor_band") == "HIGH").alias("flag")),
        F.struct(F.lit("HIGH+MEDIUM").alias("rule"), F.col("sif_precursor_band").isin("HIGH", "MEDIUM").alias("flag")),
    )
    long = rows.select("truth", "split", F.explode(rules).alias("x")).select("truth", "split", "x.rule", "x.flag")
    return ev.with_metrics(long.groupBy("split", "rule").agg(*ev.confusion(F.col("flag"), F.col("truth"))))


def score_consistency(spark, sf):
    rows = tb.reports(spark, sf)
    return ev.score_consistency(rows.select("report_id", F.col("p").alias("a")), rows.select("report_id", F.col("p2").alias("b")))


#: All narrative features, and those that may be null.
NUMERIC = spans.precursor_feature_names()
NULLABLE = ["max_height_m", "max_voltage_v"]


def _numeric(spark, sf):
    return features_v02(spark, sf).select("report_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC])


def train_all_missing(spark, sf):
    """Columns without any value on the training rows."""
    train = _numeric(spark, sf).withColumn("always_missing", F.lit(None).cast("double"))
    train = train.join(group_safe_split(spark, sf).where("split = 'train'").select("report_id"), "report_id", "left_semi")
    names = [*NUMERIC, "always_missing"]
    counts = train.agg(*[F.count(c).alias(c) for c in names])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("values")) for c in names])).alias("x"))
    return long.select("x.feature", F.col("x.values").alias("values"), (F.col("x.values") == 0).alias("dropped"))


def impute_with_indicator(spark, sf):
    from hazardloom.operators.modelling import impute_with_indicator as impute

    return impute(_numeric(spark, sf).select("report_id", *NULLABLE, "narrative_words"), NULLABLE)


def standardize(spark, sf):
    from hazardloom.operators.modelling import standardize as scale

    return scale(_numeric(spark, sf).select("report_id", "narrative_words"), ["narrative_words"])


def feature_manifest(spark, sf):
    rows = _numeric(spark, sf)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in NUMERIC])).alias("x")).select("x.feature", "x.v")
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("v").isNull()).alias("missing"), F.countDistinct("v").alias("distinct_values"),
        F.min("v").alias("low"), F.max("v").alias("high"),
    ).withColumn("is_binary", (F.col("distinct_values") <= 2) & (F.col("low") >= 0) & (F.col("high") <= 1))


def tfidf_weights(spark, sf):
    from hazardloom.operators.modelling import tfidf

    documents = tb.load(spark, sf, "documents")
    return tfidf(tb.dealt(documents.select("doc_id", "text"), "doc_id", tb.TERM_TASK_BYTES), "doc_id", "text", tb.ACCENTED, tb.PLAIN, 10000)


QUERIES = {
    k: v
    for k, v in {
        "evidence_spans": evidence_spans, "evidence_pivot": evidence_pivot, "top_mechanisms": top_mechanisms,
        "barrier_audit": barrier_audit, "barrier_mentions": barrier_mentions, "pathway_inspection": pathway_inspection,
        "features_v02": features_v02, "ranking_audit": ranking_audit, "flagged_cases": flagged_cases,
        "triage_v08": triage_v08, "conflict_review": conflict_review, "conflict_summary": conflict_summary,
        "error_types": error_types, "queue_enrichment": queue_enrichment, "ranking_at_k": ranking_at_k,
        "priority_quartiles": priority_quartiles, "select_gold_set": select_gold_set,
        "select_calibration_02": select_calibration_02, "select_calibration_03": select_calibration_03,
        "select_boundary": select_boundary, "active_learning_scores": active_learning_scores,
        "select_active_batch": select_active_batch, "binary_metrics": binary_metrics,
        "average_precision": average_precision, "threshold_search_oof": threshold_search_oof,
        "threshold_search_floor": threshold_search_floor, "threshold_search_wide": threshold_search_wide,
        "threshold_table": threshold_table, "stratified_folds": stratified_folds, "group_folds": group_folds,
        "oof_scores": oof_scores, "fold_summary": fold_summary, "model_deltas": model_deltas, "bootstrap_ci": bootstrap_ci,
        "group_safe_split": group_safe_split, "split_profile": split_profile, "split_leakage": split_leakage,
        "split_overlap": split_overlap, "split_pair_overlap": split_pair_overlap, "greedy_group_split": greedy_group_split, "unsplit_ids": unsplit_ids, "band_rule_eval": band_rule_eval,
        "score_consistency": score_consistency, "train_all_missing": train_all_missing,
        "impute_with_indicator": impute_with_indicator, "standardize": standardize,
        "feature_manifest": feature_manifest, "tfidf_weights": tfidf_weights,
    }.items()
}
