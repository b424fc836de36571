"""Registered queries: queue, analytics, reports, preparation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.functions import text as tx
from hazardloom.functions.ordered import keep_first
from hazardloom.operators import analytics as an
from hazardloom.operators import extraction, quality, triage
from hazardloom.operators import preparation as pr
from hazardloom.plans import tables as tb


def predictions_with_metadata(spark, sf):
    """Predictions joined one-to-one to an activity table kept apart."""
    activity = extraction.activity_metadata(tb.reports(spark, sf).select("report_id", "description"))
    rows = tb.stored_predictions(spark, sf).drop("activity", "activities", "activity_evidence", "activity_count")
    return pr.with_metadata(rows, activity).select("report_id", "p", "review_priority", "site", "location", "department", "activity", "activity_count")


def _gold(spark, sf):
    """Predictions inner-joined to the gold labels."""
    gold = tb.load(spark, sf, "labels").select(tb.report_id_of(F.col("doc_id")).alias("report_id"), F.col("quality").alias("truth"))
    return tb.stored_predictions(spark, sf).join(gold, "report_id")


def labelled_predictions(spark, sf):
    """Scores beside gold and adjudicated labels, left joins, with a flag for missing ones."""
    gold = tb.load(spark, sf, "labels").select(tb.report_id_of(F.col("doc_id")).alias("report_id"), F.col("quality").alias("truth"))
    second = tb.adjudications(spark, sf).select("report_id", "adjudication_label")
    rows = tb.stored_predictions(spark, sf).select("report_id", "p").join(gold, "report_id", "left").join(second, "report_id", "left")
    return rows.withColumn("missing_label", F.col("truth").isNull())


def gold_join(spark, sf):
    return _gold(spark, sf).select("report_id", "p", "review_priority", "truth")


def overview(spark, sf):
    return an.overview(tb.stored_predictions(spark, sf))


def priority_distribution(spark, sf):
    return an.priority_distribution(tb.stored_predictions(spark, sf))


def _top(column):
    return lambda spark, sf: an.top_tokens(tb.stored_predictions(spark, sf), column, 15)


def _density(column):
    return lambda spark, sf: an.density(tb.stored_predictions(spark, sf), column, 15)


def review_stats(spark, sf):
    return an.review_stats(tb.reviews(spark, sf))


def review_queue(spark, sf):
    """The first hundred reports by priority and score, with their newest review decision."""
    cols = ["report_id", "review_priority", "p", "site", "location", "department"]
    ranked = tb.stored_predictions(spark, sf).select(*cols, triage.priority_rank(F.col("review_priority")).alias("rank"))
    top = ranked.orderBy("rank", F.desc("p"), "report_id").limit(100)
    return pr.with_review_status(top, tb.reviews(spark, sf)).drop("rank")


def queue_with_status(spark, sf):
    rows = tb.stored_predictions(spark, sf).select("report_id", "review_priority", "p")
    return pr.with_review_status(rows, tb.reviews(spark, sf))


def queue_search(spark, sf):
    """P1 and P2 reports mentioning a ladder in any of six fields that nobody has confirmed."""
    fields = ["report_id", "site", "activity", "location", "department", "description"]
    rows = tb.stored_predictions(spark, sf).where(F.col("review_priority").isin("P1", "P2"))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
    hits = rows.where(F.contains(hay, F.lit("ladder"))).select("report_id", "review_priority", "p")
    return pr.with_review_status(hits, tb.reviews(spark, sf)).where(F.col("review_status") != "CONFIRMED")


def latest_review(spark, sf):
    return pr.latest_review(tb.reviews(spark, sf))


def review_history(spark, sf):
    return tb.reviews(spark, sf).orderBy(F.desc("id")).limit(100)


def report_detail(spark, sf):
    """Every report's metadata beside each of its reviews; reports without one keep a row."""
    meta = tb.reports(spark, sf).select("report_id", "site", "location", "department")
    log = tb.reviews(spark, sf).select("report_id", F.col("id").alias("review_id"), "decision", "reviewer", "created_at")
    return meta.join(log, "report_id", "left").select(*log.columns, *[c for c in meta.columns if c != "report_id"])


def append_reviews_valid(spark, sf):
    return pr.valid_reviews(tb.reviews(spark, sf), tb.reports(spark, sf))


def _high(order, condition=None):
    def run(spark, sf):
        rows = tb.stored_predictions(spark, sf)
        rows = rows if condition is None else rows.where(condition)
        return rows.orderBy(order(), "report_id").limit(20).select("report_id", "p", "pathway_assessment")

    return run


def quality_report(spark, sf):
    return an.quality_report(tb.reports(spark, sf), "raw_text", "report_id", "raw_date")


VALUES_SHOWN = 20
DIMENSIONS = ["actual_level", "potential_level", "site", "location", "department", "risk"]


def quality_distributions(spark, sf):
    return an.value_counts(tb.reports(spark, sf), DIMENSIONS, VALUES_SHOWN)


def column_distributions(spark, sf):
    rows = triage.priority_v12(tb.stored_predictions(spark, sf))
    columns = ["review_priority", "model_evidence_conflicts", "sif_context_status", "pathway_assessment"]
    return an.value_counts(rows, columns, None, "EMPTY", True)


def _docs(spark, sf):
    return tb.dealt(tb.load(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def duplicate_groups(spark, sf):
    return pr.duplicate_groups(_docs(spark, sf), "text", "doc_id")


def duplicate_group_ids(spark, sf):
    rows = pr.numbered_groups(_docs(spark, sf), "text")
    return rows.select("doc_id", "duplicate_group_id", "duplicate_group_size", "is_duplicate")


def derived_group_id(spark, sf):
    return pr.hashed_groups(_docs(spark, sf), "text").drop("text")


def annotation_pool(spark, sf):
    rows = pr.numbered_groups(tb.reports(spark, sf).select("report_id", "raw_text", "potential_level"), "raw_text")
    return pr.annotation_pool(rows, "potential_level", "report_id").drop("raw_text")


def two_stage_dedupe(spark, sf):
    """By report over the review log, then by note: the newest review of each survives."""
    once = keep_first(tb.reviews(spark, sf), ["report_id"], [F.desc("id")])
    return keep_first(once, ["note"], [F.desc("id")]).select("id", "report_id", "note")


def dedupe_by_id(spark, sf):
    return keep_first(tb.reviews(spark, sf), ["report_id"], [F.col("id")])


def crosstab_margins(spark, sf):
    return an.crosstab_margins(tb.reports(spark, sf), "actual_level", "potential_level")


def severity_escalation(spark, sf):
    return an.severity_escalation(tb.reports(spark, sf), "actual_level", "potential_level")


def severity_ordinal(spark, sf):
    return tb.reports(spark, sf).select("report_id", tx.level_number(F.col("potential_level")).alias("level_number"))


def severity_band(spark, sf):
    return tb.reports(spark, sf).select("report_id", tx.severity_band(tx.level_number(F.col("potential_level"))).alias("band"))


def _v12(spark, sf):
    return triage.priority_v12(tb.stored_predictions(spark, sf))


def batch_audit(spark, sf):
    return an.batch_audit(_v12(spark, sf))


def evidence_coverage(spark, sf):
    return an.evidence_coverage(tb.stored_predictions(spark, sf))


def tier_metrics(spark, sf):
    return an.tier_metrics(_gold(spark, sf))


def evidence_summary(spark, sf):
    rows = tb.with_labels(tb.stored_predictions(spark, sf).drop("description"), spark, sf).withColumn("y", tx.binary_label(F.col("label")))
    return an.evidence_summary(rows.withColumn("conflict_type", triage.conflict_type(F.col("p"), F.col("y"))))


def binary_labels(spark, sf):
    rows = tb.annotations(spark, sf)
    return rows.select("report_id", tx.binary_label(F.col("sif_potential")).alias("y"))


def valid_labels(spark, sf):
    rows = tb.annotations(spark, sf).where(tx.label_text(F.col("sif_potential")).isin("YES", "NO", "UNCERTAIN"))
    return rows.select("report_id", tx.label_text(F.col("sif_potential")).alias("final_label"))


def union_completed(spark, sf):
    notes = tb.annotations(spark, sf).select("report_id", "annotation_status", "sif_potential")
    second = tb.adjudications(spark, sf).select(
        "report_id", F.col("adjudication_status").alias("annotation_status"), F.col("adjudication_reason").alias("reason")
    )
    return pr.union_completed([notes, None, second])


def _pilot(spark, sf):
    done = pr.union_completed([tb.annotations(spark, sf)])
    return done.select("report_id", "duplicate_group_id", "annotation_status", "sif_potential")


def resolve_labels(spark, sf):
    return pr.resolve_labels(_pilot(spark, sf), tb.adjudications(spark, sf)).drop("annotation_status")


def _merge_parts(spark, sf):
    notes = tb.annotations(spark, sf)
    old = notes.where(F.col("label").isNotNull()).select("report_id", F.col("label").alias("final_sif_potential"))
    new = notes.where(F.col("label").isNull()).select("report_id", "annotation_status", "sif_potential")
    return old, new


def merge_labels(spark, sf):
    return pr.merge_labels(*_merge_parts(spark, sf)).select("report_id", "final_sif_potential", "annotation_status")


def merge_report(spark, sf):
    rows = merge_labels(spark, sf)
    old = F.col("annotation_status").isNull()
    yes, no = (F.col("final_sif_potential") == v for v in ("YES", "NO"))
    return rows.agg(
        F.count_if(old).alias("previous_records"), F.count_if(old & yes).alias("previous_yes"), F.count_if(old & no).alias("previous_no"),
        F.count_if(~old).alias("new_records"), F.count_if(~old & yes).alias("new_yes"), F.count_if(~old & no).alias("new_no"),
        F.count(F.lit(1)).alias("final_records"), F.count_if(yes).alias("final_yes"), F.count_if(no).alias("final_no"),
    )


def group_label_conflicts(spark, sf):
    return quality.group_label_conflicts(tb.annotations(spark, sf), "duplicate_group_id", "sif_potential")


def annotation_stats(spark, sf):
    done = pr.union_completed([tb.annotations(spark, sf)])
    long = done.select(
        F.explode(
            F.array(
                F.struct(F.lit("label").alias("field"), tx.label_text(F.col("sif_potential")).alias("value")),
                F.struct(F.lit("confidence").alias("field"), tx.label_text(F.col("annotator_confidence")).alias("value")),
                F.struct(F.lit("evidence").alias("field"), F.when(tx.clean_or_empty(F.col("evidence_text")) == "", "missing").otherwise("present").alias("value")),
            )
        ).alias("x")
    )
    total = done.agg(F.count(F.lit(1))).scalar()
    counts = long.groupBy(F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("records"))
    return counts.withColumn("share", F.round(F.col("records") / total, 9))


def annotation_violations(spark, sf):
    return quality.annotation_violations(tb.annotations(spark, sf))


def gold_violations(spark, sf):
    return quality.gold_violations(tb.annotations(spark, sf).drop("annotator_id", "annotated_at_utc"))


def adjudication_violations(spark, sf):
    return quality.adjudication_violations(tb.adjudications(spark, sf))


def integrity_violations(spark, sf):
    """Joined to the review log without de-duplication, so repeated ids show up."""
    rows = tb.stored_predictions(spark, sf).join(tb.reviews(spark, sf).select("report_id", "decision"), "report_id", "left")
    return quality.integrity_violations(rows.withColumn("p", F.when(F.col("decision") == "REJECTED", F.col("p") + 1).otherwise(F.col("p"))))


def split_input_violations(spark, sf):
    rows = tb.annotations(spark, sf).withColumn("final_sif_potential", F.col("sif_potential"))
    return quality.split_input_violations(rows.withColumn("duplicate_group_id", F.when(F.col("label").isNotNull(), F.col("duplicate_group_id"))))


def request_violations(spark, sf):
    rows = tb.reports(spark, sf).select("report_id", "description").join(tb.reviews(spark, sf), "report_id")
    return quality.request_violations(rows.withColumn("reviewer", F.repeat("reviewer", 16)))


def batch_violations(spark, sf):
    """The review log as one upload for each decision."""
    return quality.batch_violations(tb.reviews(spark, sf), "decision")


def unused_pool(spark, sf):
    used = tb.adjudications(spark, sf)
    return tb.reports(spark, sf).join(used, "report_id", "left_anti").select("report_id")


def split_members(spark, sf):
    return tb.reports(spark, sf).join(tb.adjudications(spark, sf).where("adjudication_status = 'completed'"), "report_id", "left_semi").select("report_id", "site")


def repair_group_ids(spark, sf):
    """Adjudicated rows get their group id back from the annotation table; missing keys are marked."""
    source = tb.annotations(spark, sf).select("report_id", "duplicate_group_id")
    rows = tb.adjudications(spark, sf).join(source, "report_id", "left").select("report_id", "duplicate_group_id")
    return rows.withColumn("missing", F.col("duplicate_group_id").isNull())


def _planted(rows, key, repeated):
    """The rows, every `repeated`-th of them twice."""
    return rows.unionByName(rows.where(F.col(key) % repeated == 0))


def _joined(spark, sf, one_to_one):
    """Scores, some twice, with the metadata of their reports, of which some are missing and some there twice."""
    rows = tb.reports(spark, sf).select("doc_id", "report_id", "p", "site", "department")
    left = _planted(rows, "doc_id", 97).select("report_id", "p")
    return pr.validated_join(left, _planted(rows.where("doc_id % 83 <> 1"), "doc_id", 89).select("report_id", "site", "department"), "report_id", one_to_one)


def validated_metadata(spark, sf):
    return _joined(spark, sf, True)[0]


def broken_one_to_one(spark, sf):
    return _joined(spark, sf, True)[1]


def broken_many_to_one(spark, sf):
    return _joined(spark, sf, False)[1]


def table_overlap(spark, sf):
    """Reports that every two working tables share."""
    from hazardloom.operators import evaluation

    tables = {"reports": tb.reports(spark, sf), "adjudications": tb.adjudications(spark, sf), "reviews": tb.reviews(spark, sf), "predictions": tb.stored_predictions(spark, sf)}
    return evaluation.pairwise_overlap(tables, "report_id")


def list_values(spark, sf):
    """Parts of a text between ';' or '||'."""
    joined = F.concat(F.col("risk"), F.lit(" || ;"), F.col("site"), F.lit(";"), F.col("department"), F.lit("||"))
    return tb.reports(spark, sf).select("report_id", F.explode(tx.split_list(joined, r";|\|\|")).alias("value"))


def lenient_numbers(spark, sf):
    """Numbers read from text, null where it is none."""
    text = F.when(F.col("risk") == "Others", F.lit("n/a")).when(F.col("risk") == "Cut", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".5")))
    return tb.reports(spark, sf).select("report_id", tx.lenient_double(text).alias("number"))


def join_coverage(spark, sf):
    return pr.join_coverage(tb.reports(spark, sf), tb.reviews(spark, sf), "report_id")


def prepare_batch(spark, sf):
    chosen = tb.adjudications(spark, sf).select("report_id", F.lit("stale text").alias("description"))
    return pr.prepare_batch(chosen, tb.reports(spark, sf)).drop("description")


def canonical_reports(spark, sf):
    rows = tb.reports(spark, sf)
    raw = rows.select(
        F.col("doc_id").cast("string").alias("Unnamed: 0"), F.col("raw_date").alias("Data"), F.concat(F.lit(" "), F.col("site")).alias("Countries"),
        F.col("location").alias("Local"), F.col("department").alias("Industry Sector"), F.col("actual_level").alias("Accident Level"),
        F.col("potential_level").alias("Potential Accident Level"), F.lit(" ").alias("Genre"), F.lit("Employee").alias("Employee or Third Party"),
        F.concat(F.col("risk"), F.lit("; ;"), F.col("site")).alias("Critical Risk"), F.col("raw_text").alias("Description"),
    )
    out = pr.canonical_reports(raw)
    return out.select(
        "report_id", "source", "report_type", "timestamp", "site", "location", "department", "actual_outcome", "potential_accident_level",
        "source_gender", "source_actor_type", F.length("description").alias("chars"), F.array_join("hazards", "|").alias("hazards"),
        F.size("barriers").alias("barriers"), "near_miss", "sif_potential",
    )



QUERIES = {
    "predictions_with_metadata": predictions_with_metadata,
    "labelled_predictions": labelled_predictions,
    "gold_join": gold_join,
    "overview": overview,
    "priority_distribution": priority_distribution,
    "top_hazards": _top("hazards"),
    "top_exposures": _top("exposures"),
    "top_pathways": _top("pathways"),
    "density_site": _density("site"),
    "density_location": _density("location"),
    "density_department": _density("department"),
    "density_activity": _density("activity"),
    "review_stats": review_stats,
    "review_queue": review_queue,
    "queue_with_status": queue_with_status,
    "queue_search": queue_search,
    "latest_review": latest_review,
    "review_history": review_history,
    "report_detail": report_detail,
    "append_reviews_valid": append_reviews_valid,
    "top_high_score": _high(lambda: F.desc("p")),
    "top_no_pathway": _high(lambda: F.desc("p"), "p >= 0.75 AND pathways = ''"),
    "top_low_with_evidence": _high(lambda: F.asc("p"), "p < 0.5 AND (hazards <> '' OR exposures <> '' OR pathways <> '')"),
    "quality_report": quality_report,
    "quality_distributions": quality_distributions,
    "column_distributions": column_distributions,
    "duplicate_groups": duplicate_groups,
    "duplicate_group_ids": duplicate_group_ids,
    "derived_group_id": derived_group_id,
    "annotation_pool": annotation_pool,
    "two_stage_dedupe": two_stage_dedupe,
    "dedupe_by_id": dedupe_by_id,
    "crosstab_margins": crosstab_margins,
    "severity_escalation": severity_escalation,
    "severity_ordinal": severity_ordinal,
    "severity_band": severity_band,
    "batch_audit": batch_audit,
    "evidence_coverage": evidence_coverage,
    "tier_metrics": tier_metrics,
    "evidence_summary": evidence_summary,
    "binary_labels": binary_labels,
    "valid_labels": valid_labels,
    "union_completed": union_completed,
    "resolve_labels": resolve_labels,
    "merge_labels": merge_labels,
    "merge_report": merge_report,
    "group_label_conflicts": group_label_conflicts,
    "annotation_stats": annotation_stats,
    "annotation_violations": annotation_violations,
    "gold_violations": gold_violations,
    "adjudication_violations": adjudication_violations,
    "integrity_violations": integrity_violations,
    "split_input_violations": split_input_violations,
    "request_violations": request_violations,
    "batch_violations": batch_violations,
    "unused_pool": unused_pool,
    "split_members": split_members,
    "repair_group_ids": repair_group_ids,
    "join_coverage": join_coverage,
    "validated_metadata": validated_metadata,
    "broken_one_to_one": broken_one_to_one,
    "broken_many_to_one": broken_many_to_one,
    "table_overlap": table_overlap,
    "list_values": list_values,
    "lenient_numbers": lenient_numbers,
    "prepare_batch": prepare_batch,
    "canonical_reports": canonical_reports,
}
