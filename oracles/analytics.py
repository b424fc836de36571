"""Queue, analytics, preparation and validation oracles."""

from __future__ import annotations

from hazardloom.banks import extraction_v04 as v04
from oracles.base import ADJUDICATIONS, ANNOTATIONS, MATCH, REPORTS, REVIEWS, q, r9, with_
from oracles.evidence import CONFLICTED, PREDICTIONS, V12_CONFLICTS
from oracles.extraction import hits

ACTIVITY = """acts AS (SELECT report_id, string_agg(label, '; ' ORDER BY rn) AS activities FROM (SELECT report_id, label, min(rn) AS rn FROM ac GROUP BY 1, 2) GROUP BY 1),
meta AS (SELECT p.*, nullif(a.activities, '') AS activity, coalesce(n.n, 0)::int AS activity_count FROM predictions p LEFT JOIN acts a USING (report_id)
  LEFT JOIN (SELECT report_id, count(*) AS n FROM ac GROUP BY 1) n USING (report_id))"""
META = PREDICTIONS + ",\nbase AS (SELECT report_id, description AS tx FROM reports),\n" + hits("ac", v04.ACTIVITIES, 5) + ",\n" + ACTIVITY
LATEST = "latest AS (SELECT * FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM reviews o WHERE o.report_id = r.report_id AND o.id > r.id))"
GOLD = "gold AS (SELECT p.*, l.quality AS truth FROM predictions p JOIN labels l ON l.doc_id = p.doc_id)"
V12 = f"""v12a AS (SELECT *, {V12_CONFLICTS} AS model_evidence_conflicts FROM predictions),
v12 AS (SELECT * REPLACE (CASE WHEN model_evidence_conflicts <> '' THEN 'P1' WHEN p >= 0.8 THEN 'P2' WHEN p >= 0.5 OR complete_pathway = 1 THEN 'P3' WHEN pathway_signal_strength > 0 THEN 'P4' ELSE 'P5' END AS review_priority) FROM v12a)"""
DOMAIN = "(VALUES ('P1'), ('P2'), ('P3'), ('P4'), ('P5')) d(review_priority)"
DOCS = f"docs AS (SELECT doc_id, text AS raw_text FROM documents), matched AS (SELECT *, {MATCH} AS nm FROM docs)"
DONE = "done AS (SELECT * FROM annotations WHERE lower(trim(annotation_status)) = 'completed')"


def top(column: str) -> str:
    return with_(PREDICTIONS) + f"""SELECT category, count(*)::bigint AS records FROM (SELECT unnest(string_split({column}, ' | ')) AS category FROM predictions)
  WHERE category <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""


def density(column: str, source: str = "predictions", ctes: str = PREDICTIONS) -> str:
    return with_(ctes) + f"""SELECT category, records, model_flags, avg_probability, round(rate, 4) AS model_flag_rate FROM (
  SELECT {column} AS category, count(*)::bigint AS records, count(*) FILTER (p >= 0.5)::bigint AS model_flags, round(avg(p), 4) AS avg_probability,
  count(*) FILTER (p >= 0.5) / count(*)::double AS rate FROM {source} WHERE {column} IS NOT NULL AND trim({column}) <> '' GROUP BY 1 ORDER BY rate DESC, records DESC, 1 LIMIT 15)"""


def counts_long(columns, source: str, top_n: int | None, empty: str, blank: bool = False) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", coalesce({'nullif(trim(' + c + chr(41) + ', ' + chr(39) * 2 + ')' if blank else c}, {q(empty)}) AS value FROM {source}" for c in columns
    )
    return f"""SELECT "column", value, records FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY records DESC, value) AS rn FROM (
  SELECT "column", value, count(*)::bigint AS records FROM ({parts}) GROUP BY 1, 2)) WHERE rn <= {1 << 60 if top_n is None else top_n}"""


def _pct(cond: str) -> str:
    return f"round(100.0 * count(*) FILTER ({cond}) / count(*), 6)"


def _c(cond: str) -> str:
    return f"(count(*) FILTER ({cond}))::bigint"


ANNOTATION_RULES = [
    ("error", "invalid_label", "upper(trim(sif_potential)) NOT IN ('YES', 'NO', 'UNCERTAIN')"),
    ("error", "missing_reason", "trim(coalesce(sif_reason, '')) = ''"),
    ("error", "evidence_required", "upper(trim(sif_potential)) IN ('YES', 'UNCERTAIN') AND trim(coalesce(evidence_text, '')) = ''"),
    ("error", "invalid_confidence", "upper(trim(annotator_confidence)) NOT IN ('HIGH', 'MEDIUM', 'LOW')"),
]
WHO = [("warning", "missing_annotator", "trim(coalesce(annotator_id, '')) = ''"), ("warning", "missing_timestamp", "trim(coalesce(annotated_at_utc, '')) = ''")]


def rule_union(rules, source: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT report_id, {q(s)} AS severity, {q(n)} AS rule FROM {source} WHERE ({where}) AND ({c})" for s, n, c in rules)


def _duplicates(source: str) -> str:
    return f" UNION ALL SELECT report_id, 'error', 'duplicate_id' FROM {source} GROUP BY report_id HAVING count(*) > 1"


def annotation_rules(who) -> str:
    return with_(REPORTS, ANNOTATIONS, DONE) + rule_union([*ANNOTATION_RULES, *who], "done") + """
  UNION ALL SELECT report_id, 'error', 'invalid_status' FROM annotations WHERE lower(trim(annotation_status)) NOT IN ('pending', 'completed')""" + _duplicates("annotations") + """
  UNION ALL SELECT duplicate_group_id, 'error', 'group_label_conflict' FROM done GROUP BY 1 HAVING count(DISTINCT upper(trim(sif_potential))) > 1"""


PLANTED = """lf AS (SELECT report_id, p FROM reports UNION ALL SELECT report_id, p FROM reports WHERE doc_id % 97 = 0),
rg AS (SELECT * FROM reports WHERE doc_id % 83 <> 1 UNION ALL SELECT * FROM reports WHERE doc_id % 83 <> 1 AND doc_id % 89 = 0),
rc AS (SELECT report_id, count(*) AS n, min(site) AS site, min(department) AS department FROM rg GROUP BY 1)"""
BROKEN = """bk AS (SELECT report_id, count(*)::bigint AS left_rows, coalesce(max(n), 0)::bigint AS right_rows,
  CASE WHEN max(n) IS NULL THEN 'missing' WHEN max(n) > 1 THEN 'right_repeated' WHEN count(*) > 1 THEN 'left_repeated' END AS problem FROM lf LEFT JOIN rc USING (report_id) GROUP BY 1)"""


def oracles() -> dict[str, str]:
    rank = "CASE review_priority WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 WHEN 'P4' THEN 4 WHEN 'P5' THEN 5 ELSE 9 END"
    priorities = ["P1", "P2", "P3", "P4", "P5"]
    adj = [
        ("error", "invalid_label", "upper(trim(adjudication_label)) NOT IN ('YES', 'NO', 'UNCERTAIN')"), ("error", "missing_reason", "trim(coalesce(adjudication_reason, '')) = ''"),
        ("error", "invalid_confidence", "upper(trim(adjudication_confidence)) NOT IN ('HIGH', 'MEDIUM', 'LOW')"), ("warning", "missing_annotator", "trim(coalesce(adjudicator_id, '')) = ''"),
        ("warning", "missing_timestamp", "trim(coalesce(adjudicated_at_utc, '')) = ''"),
    ]
    top_sql = lambda where, order: with_(PREDICTIONS) + f"SELECT report_id, p, pathway_assessment FROM predictions WHERE {where} ORDER BY p {order}, report_id LIMIT 20"
    merged = f"""mg AS (SELECT report_id, label AS final_sif_potential, NULL::varchar AS annotation_status FROM annotations WHERE label IS NOT NULL UNION ALL
  SELECT report_id, upper(trim(sif_potential)), annotation_status FROM annotations WHERE label IS NULL AND upper(trim(sif_potential)) IN ('YES', 'NO') AND lower(trim(annotation_status)) = 'completed')"""
    return {
        "predictions_with_metadata": with_(META) + "SELECT report_id, p, review_priority, site, location, department, activity, activity_count FROM meta",
        "labelled_predictions": with_(PREDICTIONS, ADJUDICATIONS) + """SELECT p.report_id, p.p, l.quality AS truth, a.adjudication_label, l.quality IS NULL AS missing_label FROM predictions p
  LEFT JOIN labels l ON l.doc_id = p.doc_id LEFT JOIN adjudications a ON a.report_id = p.report_id""",
        "gold_join": with_(PREDICTIONS, GOLD) + "SELECT report_id, p, review_priority, truth FROM gold",
        "overview": with_(META) + f"""SELECT count(*)::bigint AS records, {_c('p >= 0.5')} AS model_yes_ge_0_50, {_c('p >= 0.75')} AS high_ge_0_75, {_c('p >= 0.9')} AS very_high_ge_0_90,
  round(avg(p), 4) AS mean_probability, {_c('complete_pathway = 1')} AS complete_pathways, round(100.0 * {_c('hazard_signal = 1')} / count(*), 4) AS hazard_signal_pct,
  round(100.0 * {_c('exposure_signal = 1')} / count(*), 4) AS exposure_signal_pct, round(100.0 * {_c('pathway_signal = 1')} / count(*), 4) AS pathway_signal_pct,
  {', '.join(_c(f"review_priority = '{x}'") + ' AS ' + x.lower() for x in priorities)}, bool_or(activity IS NOT NULL) AS activity_metadata_available, round(median(p), 4) AS median_probability FROM meta""",
        "priority_distribution": with_(PREDICTIONS) + f"SELECT d.review_priority, coalesce(n, 0)::bigint AS records FROM {DOMAIN} LEFT JOIN (SELECT review_priority, count(*) AS n FROM predictions GROUP BY 1) USING (review_priority)",
        "top_hazards": top("hazards"), "top_exposures": top("exposures"), "top_pathways": top("pathways"),
        "density_site": density("site"), "density_location": density("location"), "density_department": density("department"),
        "density_activity": density("activity", "meta", META),
        "review_stats": with_(REVIEWS) + """SELECT 'total' AS scope, 'all' AS value, count(*)::bigint AS reviews FROM reviews UNION ALL
  SELECT 'decision', decision, count(*) FROM reviews GROUP BY decision UNION ALL SELECT 'reviewer', reviewer, count(*) FROM reviews GROUP BY reviewer""",
        "review_queue": with_(PREDICTIONS, REVIEWS, LATEST) + f"""SELECT t.report_id, review_priority, p, site, location, department, coalesce(l.decision, 'UNREVIEWED') AS review_status FROM
  (SELECT * FROM predictions ORDER BY {rank}, p DESC, report_id LIMIT 100) t LEFT JOIN latest l ON l.report_id = t.report_id""",
        "queue_with_status": with_(PREDICTIONS, REVIEWS, LATEST) + "SELECT p.report_id, review_priority, p, coalesce(l.decision, 'UNREVIEWED') AS review_status FROM predictions p LEFT JOIN latest l ON l.report_id = p.report_id",
        "queue_search": with_(META, REVIEWS, LATEST) + """SELECT m.report_id, review_priority, p, coalesce(l.decision, 'UNREVIEWED') AS review_status FROM meta m LEFT JOIN latest l ON l.report_id = m.report_id
  WHERE review_priority IN ('P1', 'P2') AND coalesce(l.decision, 'UNREVIEWED') <> 'CONFIRMED' AND (contains(lower(m.report_id), 'ladder') OR contains(lower(site), 'ladder') OR contains(lower(coalesce(activity, '')), 'ladder')
  OR contains(lower(location), 'ladder') OR contains(lower(department), 'ladder') OR contains(lower(description), 'ladder'))""",
        "latest_review": with_(REVIEWS, LATEST) + "SELECT report_id, id, decision, reviewer, note, created_at FROM latest",
        "review_history": with_(REVIEWS) + "SELECT * FROM reviews ORDER BY id DESC LIMIT 100",
        "report_detail": with_(REPORTS, REVIEWS) + "SELECT r.report_id, site, location, department, v.id AS review_id, v.decision, v.reviewer, v.created_at FROM reports r LEFT JOIN reviews v ON v.report_id = r.report_id",
        "append_reviews_valid": with_(REPORTS, REVIEWS) + "SELECT id, report_id, decision, trim(reviewer) AS reviewer, trim(note) AS note, created_at FROM reviews WHERE report_id IN (SELECT report_id FROM reports)",
        "top_high_score": top_sql("true", "DESC"), "top_no_pathway": top_sql("p >= 0.75 AND len(pw) = 0", "DESC"), "top_low_with_evidence": top_sql("p < 0.5 AND pathway_signal_strength > 0", "ASC"),
        "quality_report": with_(REPORTS, "s AS (SELECT report_id, regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') AS t, try_cast(raw_date AS timestamp) AS ts FROM reports)") + """SELECT count(*)::bigint AS records, count(*) FILTER (t = '')::bigint AS empty_description_count,
  min(length(t))::bigint AS min_characters, max(length(t))::bigint AS max_characters, round(avg(length(t)), 2) AS mean_characters, count(*) FILTER (ts IS NULL)::bigint AS invalid_timestamps,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_timestamp, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_timestamp, median(length(t)) AS median_characters, count(DISTINCT t)::bigint AS unique_description_count,
  (SELECT coalesce(sum(n), 0)::bigint FROM (SELECT count(*) AS n FROM s GROUP BY t) WHERE n > 1) AS duplicate_description_records, (count(*) - count(DISTINCT report_id))::bigint AS duplicate_report_ids FROM s""",
        "quality_distributions": with_(REPORTS) + counts_long(["actual_level", "potential_level", "site", "location", "department", "risk"], "reports", 20, "<NULL>"),
        "column_distributions": with_(PREDICTIONS, V12) + counts_long(["review_priority", "model_evidence_conflicts", "sif_context_status", "pathway_assessment"], "v12", None, "EMPTY", True),
        "duplicate_groups": with_(DOCS) + "SELECT sha256(nm) AS group_key, n::bigint AS record_count, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY nm) AS n FROM matched) WHERE n > 1",
        "duplicate_group_ids": with_(DOCS) + """SELECT doc_id, 'DUP_' || CASE WHEN k < 10000 THEN lpad(k::varchar, 4, '0') ELSE k::varchar END AS duplicate_group_id, n::bigint AS duplicate_group_size, n > 1 AS is_duplicate FROM
  (SELECT doc_id, dense_rank() OVER (ORDER BY nm) AS k, count(*) OVER (PARTITION BY nm) AS n FROM matched)""",
        "derived_group_id": with_(DOCS) + "SELECT doc_id, 'derived_' || substr(sha256(nm), 1, 16) AS derived_group_id FROM matched",
        "annotation_pool": with_(REPORTS, f"m AS (SELECT report_id, potential_level, {MATCH} AS nm, list_position(['I','II','III','IV','V','VI'], potential_level)::int AS lv FROM reports)") + """SELECT report_id, potential_level, duplicate_group_size,
  'DUP_' || CASE WHEN k < 10000 THEN lpad(k::varchar, 4, '0') ELSE k::varchar END AS duplicate_group_id, duplicate_group_size > 1 AS is_duplicate, lv AS potential_level_numeric FROM (
  SELECT *, dense_rank() OVER (ORDER BY nm) AS k, count(*) OVER (PARTITION BY nm)::bigint AS duplicate_group_size, row_number() OVER (PARTITION BY nm ORDER BY lv DESC, report_id) AS rn FROM m) WHERE rn = 1""",
        "two_stage_dedupe": with_(REVIEWS, LATEST) + "SELECT max(id) AS id, arg_max(report_id, id) AS report_id, note FROM latest GROUP BY note",
        "dedupe_by_id": with_(REVIEWS) + "SELECT r.* FROM reviews r JOIN (SELECT report_id, min(id) AS id FROM reviews GROUP BY 1) f ON f.id = r.id",
        "crosstab_margins": with_(REPORTS) + "SELECT coalesce(actual_level, 'All') AS actual_level, coalesce(potential_level, 'All') AS potential_level, count(*)::bigint AS records FROM reports GROUP BY CUBE (reports.actual_level, reports.potential_level)",
        "severity_escalation": with_(REPORTS) + "SELECT count(*)::bigint AS records, count(*) FILTER (g)::bigint AS higher_potential, round(count(*) FILTER (g) / count(*)::double, 9) AS share FROM (SELECT list_position(['I','II','III','IV','V','VI'], potential_level) > list_position(['I','II','III','IV','V','VI'], actual_level) AS g FROM reports)",
        "severity_ordinal": with_(REPORTS) + "SELECT report_id, CASE potential_level WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 WHEN 'VI' THEN 6 END AS level_number FROM reports",
        "severity_band": with_(REPORTS) + "SELECT report_id, CASE WHEN potential_level IN ('I', 'II') THEN 'low' WHEN potential_level = 'III' THEN 'medium' WHEN potential_level = 'IV' THEN 'high' WHEN potential_level IN ('V', 'VI') THEN 'very_high' ELSE 'unknown' END AS band FROM reports",
        "batch_audit": with_(PREDICTIONS, V12) + f"""SELECT count(*)::bigint AS records, {_c('p >= 0.5')} AS predicted_yes, {_c('p < 0.5')} AS predicted_no, {_c('p >= 0.75')} AS high_ge_0_75, {_c('p >= 0.8')} AS high_ge_0_80,
  {_c('p >= 0.5 AND p < 0.75')} AS moderate_0_50_to_0_75, round(avg(p), 6) AS mean_probability, {_pct('len(hz) > 0')} AS hazard_signal_pct, {_pct('len(ex) > 0')} AS exposure_signal_pct, {_pct('len(pw) > 0')} AS pathway_signal_pct,
  {_pct('complete_pathway = 1')} AS complete_pathway_pct, {_pct('len(hz) = 0')} AS no_hazard_evidence_pct, {_pct('len(ex) = 0')} AS no_exposure_evidence_pct, {_pct('len(pw) = 0')} AS no_pathway_evidence_pct,
  {_c("sif_context_status = 'UNKNOWN'")} AS unknown_context, {_c("sif_context_status = 'CONTEXT_LIMITED'")} AS limited_context, {_c("sif_context_status = 'SUFFICIENT_CONTEXT'")} AS sufficient_context,
  {_c("model_evidence_conflicts <> ''")} AS any_conflict, {_pct("model_evidence_conflicts <> ''")} AS any_conflict_pct, {_c("p >= 0.75 AND sif_context_status IN ('UNKNOWN', 'CONTEXT_LIMITED')")} AS high_score_and_unknown_or_limited,
  {_c('p >= 0.75 AND len(pw) = 0')} AS high_score_and_no_pathway, {_c('p >= 0.75 AND complete_pathway = 1')} AS high_score_and_complete_pathway,
  {', '.join(_c(f"review_priority = '{x}'") + f' AS {x.lower()}_records, ' + _pct(f"review_priority = '{x}'") + f' AS {x.lower()}_pct' for x in priorities)}, round(median(p), 6) AS median_probability FROM v12""",
        "evidence_coverage": with_(PREDICTIONS) + " UNION ALL ".join(f"SELECT {q(s)} AS signal, {_c(c + ' = 1')} AS records, {_pct(c + ' = 1')} AS pct FROM predictions" for s, c in [("hazard", "hazard_signal"), ("exposure", "exposure_signal"), ("pathway", "pathway_signal"), ("complete_pathway", "complete_pathway")]),
        "tier_metrics": with_(PREDICTIONS, GOLD) + f"""SELECT d.review_priority, coalesce(records, 0)::bigint AS records, coalesce(yes, 0)::bigint AS yes, coalesce(no, 0)::bigint AS no, gold_positive_rate, mean_probability, median_probability FROM {DOMAIN} LEFT JOIN (
  SELECT review_priority, count(*) AS records, {_c('truth = 1')} AS yes, {_c('truth = 0')} AS no, {r9('avg(truth::double)')} AS gold_positive_rate, {r9('avg(p)')} AS mean_probability, median(p) AS median_probability FROM gold GROUP BY 1) USING (review_priority)""",
        "evidence_summary": with_(CONFLICTED) + f"""SELECT count(*)::bigint AS records, {r9('avg(hazard_signal)')} AS hazard_rate, {r9('avg(exposure_signal)')} AS exposure_rate, {r9('avg(pathway_signal)')} AS pathway_rate, {r9('avg(complete_pathway)')} AS complete_rate,
  {', '.join(_c(f"pathway_assessment = '{x}'") + ' AS ' + x.lower() for x in ('SUPPORTED', 'PARTIAL', 'WEAK', 'NONE'))}, {', '.join(_c(f"sif_context_status = '{x}'") + ' AS ' + x.lower() for x in ('CONTEXT_AGAINST_SIF', 'SUFFICIENT_CONTEXT', 'CONTEXT_LIMITED', 'UNKNOWN'))},
  {_c("conflict_type IN ('FALSE_POSITIVE', 'HIGH_SCORE_FALSE_POSITIVE')")} AS false_positives, {_c("conflict_type IN ('FALSE_NEGATIVE', 'FALSE_NEGATIVE_WITH_EVIDENCE')")} AS false_negatives FROM conflicted""",
        "binary_labels": with_(REPORTS, ANNOTATIONS) + "SELECT report_id, CASE upper(sif_potential) WHEN 'YES' THEN 1 WHEN 'NO' THEN 0 END AS y FROM annotations",
        "valid_labels": with_(REPORTS, ANNOTATIONS) + "SELECT report_id, upper(sif_potential) AS final_label FROM annotations WHERE sif_potential <> 'MAYBE'",
        "union_completed": with_(REPORTS, ANNOTATIONS, ADJUDICATIONS, DONE) + "SELECT report_id, annotation_status, sif_potential, NULL::varchar AS reason FROM done UNION ALL SELECT report_id, adjudication_status, NULL, adjudication_reason FROM adjudications WHERE adjudication_status = 'completed'",
        "resolve_labels": with_(REPORTS, ANNOTATIONS, ADJUDICATIONS, DONE, """rs AS (SELECT d.report_id, duplicate_group_id, sif_potential, coalesce(upper(a.adjudication_label), upper(trim(sif_potential))) AS final_sif_potential,
  CASE WHEN a.report_id IS NULL THEN 'pilot' ELSE 'adjudicated' END AS label_source FROM done d LEFT JOIN adjudications a ON a.report_id = d.report_id AND a.adjudication_status = 'completed')""") + """SELECT *, final_sif_potential = 'UNCERTAIN' AS is_uncertain,
  final_sif_potential IN ('YES', 'NO') AS usable_for_binary_sif_model FROM rs WHERE final_sif_potential IN ('YES', 'NO', 'UNCERTAIN')""",
        "merge_labels": with_(REPORTS, ANNOTATIONS, merged) + "SELECT * FROM mg",
        "merge_report": with_(REPORTS, ANNOTATIONS, merged) + f"""SELECT {_c('annotation_status IS NULL')} AS previous_records, {_c("annotation_status IS NULL AND final_sif_potential = 'YES'")} AS previous_yes, {_c("annotation_status IS NULL AND final_sif_potential = 'NO'")} AS previous_no,
  {_c('annotation_status IS NOT NULL')} AS new_records, {_c("annotation_status IS NOT NULL AND final_sif_potential = 'YES'")} AS new_yes, {_c("annotation_status IS NOT NULL AND final_sif_potential = 'NO'")} AS new_no,
  count(*)::bigint AS final_records, {_c("final_sif_potential = 'YES'")} AS final_yes, {_c("final_sif_potential = 'NO'")} AS final_no FROM mg""",
        "group_label_conflicts": with_(REPORTS, ANNOTATIONS) + "SELECT duplicate_group_id, count(DISTINCT upper(sif_potential))::bigint AS labels, count(*)::bigint AS records FROM annotations GROUP BY 1 HAVING labels > 1",
        "annotation_stats": with_(REPORTS, ANNOTATIONS, DONE, """lg AS (SELECT 'label' AS field, upper(sif_potential) AS value FROM done UNION ALL SELECT 'confidence', upper(annotator_confidence) FROM done UNION ALL SELECT 'evidence', CASE WHEN evidence_text IS NULL THEN 'missing' ELSE 'present' END FROM done)""") + f"SELECT field, value, count(*)::bigint AS records, {r9('count(*) / (SELECT count(*) FROM done)::double')} AS share FROM lg GROUP BY 1, 2",
        "annotation_violations": annotation_rules(WHO),
        "gold_violations": annotation_rules([("warning", "missing_annotator", "true"), ("warning", "missing_timestamp", "true")]),
        "adjudication_violations": with_(ADJUDICATIONS) + rule_union(adj, "adjudications", "adjudication_status = 'completed'") + _duplicates("adjudications"),
        "integrity_violations": with_(PREDICTIONS, REVIEWS, "j AS (SELECT p.report_id, description, review_priority, CASE WHEN r.decision = 'REJECTED' THEN p + 1 ELSE p END AS p FROM predictions p LEFT JOIN reviews r ON r.report_id = p.report_id)")
        + rule_union([("error", "score_range", "p > 1 OR p < 0")], "j") + _duplicates("j"),
        "split_input_violations": with_(REPORTS, ANNOTATIONS) + rule_union([("error", "missing_group", "label IS NULL"), ("error", "invalid_label", "upper(sif_potential) NOT IN ('YES', 'NO')")], "annotations"),
        "request_violations": with_(REPORTS, REVIEWS, "j AS (SELECT r.report_id, description, repeat(v.reviewer, 16) AS reviewer, note, decision FROM reports r JOIN reviews v ON v.report_id = r.report_id)")
        + rule_union([("error", "text_length", "length(coalesce(description, '')) NOT BETWEEN 1 AND 20000"), ("error", "unknown_decision", "decision IS NULL OR decision NOT IN ('CONFIRMED', 'REJECTED', 'NEEDS_MORE_INFO')"),
            ("error", "reviewer_length", "length(coalesce(reviewer, '')) NOT BETWEEN 1 AND 120"), ("error", "note_length", "length(note) > 4000"), ("error", "id_length", "length(report_id) NOT BETWEEN 1 AND 200")], "j"),
        "batch_violations": with_(REVIEWS) + "SELECT decision AS batch, count(*)::bigint AS records, 'batch_size' AS rule FROM reviews GROUP BY 1 HAVING count(*) > 500",
        "unused_pool": with_(REPORTS, ADJUDICATIONS) + "SELECT report_id FROM reports EXCEPT SELECT report_id FROM adjudications",
        "split_members": with_(REPORTS, ADJUDICATIONS) + "SELECT report_id, site FROM reports WHERE report_id IN (SELECT report_id FROM adjudications WHERE adjudication_status = 'completed')",
        "repair_group_ids": with_(REPORTS, ANNOTATIONS, ADJUDICATIONS) + "SELECT a.report_id, n.duplicate_group_id, n.report_id IS NULL AS missing FROM adjudications a LEFT JOIN annotations n USING (report_id)",
        "validated_metadata": with_(REPORTS, PLANTED) + "SELECT l.report_id, p, CASE WHEN n = 1 THEN site END AS site, CASE WHEN n = 1 THEN department END AS department FROM lf l LEFT JOIN rc ON rc.report_id = l.report_id",
        "broken_one_to_one": with_(REPORTS, PLANTED, BROKEN) + "SELECT * FROM bk WHERE problem IS NOT NULL",
        "broken_many_to_one": with_(REPORTS, PLANTED, BROKEN) + "SELECT * FROM bk WHERE problem <> 'left_repeated'",
        "table_overlap": with_(REPORTS, ADJUDICATIONS, REVIEWS, "tk AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS t, {i} AS o, report_id FROM {src}" for i, (n, src) in enumerate((("reports", "reports"), ("adjudications", "adjudications"), ("reviews", "reviews"), ("predictions", "reports")))) + ")")
        + "SELECT x.t AS a, y.t AS b, count(*)::bigint AS shared FROM tk x JOIN tk y ON x.report_id = y.report_id AND x.o < y.o GROUP BY 1, 2",
        "list_values": with_(REPORTS) + "SELECT report_id, unnest([risk, site, department]) AS value FROM reports",
        "lenient_numbers": with_(REPORTS) + "SELECT report_id, CASE WHEN risk IN ('Others', 'Cut') THEN NULL ELSE doc_id + 0.5::double END AS number FROM reports",
        "join_coverage": with_(REPORTS, REVIEWS) + """SELECT report_id, 'both' AS origin FROM (SELECT report_id FROM reports INTERSECT SELECT report_id FROM reviews) UNION ALL SELECT report_id, 'left_only' FROM (SELECT report_id FROM reports EXCEPT SELECT report_id FROM reviews)
  UNION ALL SELECT report_id, 'right_only' FROM (SELECT report_id FROM reviews EXCEPT SELECT report_id FROM reports)""",
        "prepare_batch": with_(REPORTS, ADJUDICATIONS) + """SELECT a.report_id, r.site, r.department, 'pending' AS annotation_status, 'active_learning' AS annotation_round, 'v0.2' AS annotation_version, '' AS sif_potential, '' AS sif_reason, '' AS evidence_text,
  '' AS annotator_confidence, '' AS annotator_id FROM adjudications a LEFT JOIN reports r USING (report_id)""",
        "canonical_reports": with_(REPORTS) + """SELECT 'industrial_safety_' || printf('%06d', doc_id) AS report_id, 'industrial_safety' AS source, 'incident' AS report_type, strftime(try_cast(raw_date AS timestamp), '%Y-%m-%dT%H:%M:%S') AS timestamp,
  site, location, department, actual_level AS actual_outcome, potential_level AS potential_accident_level, NULL::varchar AS source_gender, 'Employee' AS source_actor_type, length(trim(raw_text, ' '))::int AS chars, risk || '|' || site AS hazards, 0 AS barriers, NULL::boolean AS near_miss, NULL::varchar AS sif_potential FROM reports""",
    }
