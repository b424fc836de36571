"""Scalar, audit, structured-feature and stream oracles."""

from __future__ import annotations

from hazardloom.banks import rules as rule_bank
from hazardloom.banks import structured_features as sf
from hazardloom.banks.precursors import BODY_PARTS
from hazardloom.functions.text import FIRST_STOP_WORDS, STOP_WORDS
from hazardloom.operators import structured
from hazardloom.operators.tagging import pathway_feature_names
from hazardloom.plans import tables as tb
from hazardloom.plans.model_queries import CUE, HEIGHT
from oracles.base import MATCH, NORM, REPORTS, REVIEWS, SQUEEZE, h, present, q, qlist, r9, with_
from oracles.evidence import PREDICTIONS, RENDER, candidates_cte
from oracles.analytics import LATEST
from oracles.extraction import V06, extract_v04_sql

DOCS = "docs AS (SELECT doc_id, text AS raw_text, text AS description, source FROM documents)"


def tokens(text: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND NOT list_contains({qlist(STOP_WORDS)}, w)))"


def first_tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(replace(lower({text}), chr(160), ' '), '[a-z][a-z0-9-]{{2,}}'), lambda w: NOT list_contains({qlist(FIRST_STOP_WORDS)}, w)))"


FAMS = {"hazards": "hazard_evidence", "exposures": "exposure_evidence", "consequences": "consequence_evidence", "barriers": "barrier_evidence"}
A, B = f"({h('a')} % 24)", f"({h('b')} % 16)"
NOTES = f"""notes AS (SELECT report_id, {qlist(tb.SETTINGS)}[{A} + 1] AS hazards_n, CASE WHEN {A} < 10 THEN {qlist(tb.SETTINGS)}[{A} + 1] ELSE '' END AS exposures_n,
  CASE WHEN {B} BETWEEN 1 AND 3 THEN {qlist(tb.OUTCOMES)}[{B} + 1] ELSE '' END AS consequences_n, CASE WHEN {B} BETWEEN 5 AND 10 THEN {qlist(tb.OUTCOMES)}[{B} + 1] ELSE '' END AS barriers_n
  FROM (SELECT doc_id, 'report_' || printf('%06d', doc_id) AS report_id FROM documents))"""


def audit_ctes() -> str:
    long = " UNION ALL ".join(f"SELECT n.report_id, {q(k)} AS family, n.{k}_n AS human, f.{k} AS found, f.{e} AS evidence FROM notes n JOIN fl f USING (report_id)" for k, e in FAMS.items())
    rec = "CASE WHEN len(ht) = 0 OR len(ft) = 0 THEN 0 ELSE len(list_intersect(ht, ft)) / len(ht)::double END"
    old = "CASE WHEN len(h1) = 0 AND len(f1) = 0 THEN 'NO_SIGNAL' WHEN len(f1) = 0 THEN 'MISSED_CATEGORY' WHEN len(h1) = 0 THEN 'POSSIBLE_FALSE_POSITIVE'"
    return f"""fl AS MATERIALIZED ({extract_v04_sql()}), {NOTES}, lg AS MATERIALIZED ({long}),
tk AS (SELECT *, {tokens('human')} AS ht, {tokens('found')} AS ft, {first_tokens('human')} AS h1, {first_tokens('found')} AS f1 FROM lg),
ad0 AS (SELECT *, round({rec}, 4) AS token_recall, len(list_intersect(h1, f1)) AS both1 FROM tk),
ad AS (SELECT report_id, family, human, found, evidence, token_recall, CASE WHEN human = '' AND found = '' THEN 'NO_SIGNAL' WHEN found = '' THEN 'MISSED_CATEGORY' WHEN human = '' THEN 'POSSIBLE_FALSE_POSITIVE' WHEN token_recall >= 0.5 THEN 'REASONABLE_LEXICAL_OVERLAP'
  WHEN token_recall > 0 THEN 'PARTIAL_COVERAGE' WHEN evidence <> '' THEN 'CATEGORY_PRESENT_BUT_LOW_LEXICAL_OVERLAP' ELSE 'CATEGORY_PRESENT_NO_OVERLAP' END AS audit_hint,
  {old} WHEN both1 / len(h1)::double >= 0.5 THEN 'REASONABLE_LEXICAL_OVERLAP' WHEN both1 > 0 THEN 'PARTIAL_COVERAGE' ELSE 'LOW_SEMANTIC_OVERLAP' END AS recall_hint,
  {old} WHEN both1 = 0 THEN 'LOW_SEMANTIC_OVERLAP' WHEN both1 < greatest(2, floor(0.2::double * len(h1))) THEN 'PARTIAL_COVERAGE' ELSE 'REASONABLE_LEXICAL_OVERLAP' END AS count_hint FROM ad0)"""


def near(t: str, cue: str) -> str:
    """Windows around every hit from the text pieces between hits; the lengths before a piece give its place."""
    return f"""(WITH w AS (SELECT regexp_extract_all({t}, {q(cue)}) AS hit, string_split_regex({t}, {q(cue)}) AS gap),
  p AS (SELECT unnest(range(1, len(hit) + 1)) AS i, hit, gap FROM w),
  o AS (SELECT length(hit[i]) AS n, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) + 1 AS pos_ FROM p)
  SELECT max(list_max(list_transform(regexp_extract_all(substr({t}, greatest(pos_ - 45, 1)::bigint, (pos_ - greatest(pos_ - 45, 1) + n + 45)::bigint), '(?:^|[^a-z])(\\d+(?:[.,]\\d+)?)', 1), lambda x: try_cast(replace(x, ',', '.') AS double)))) FROM o)"""


def features_v01() -> str:
    cols = []
    for pre, src, table in (("hazard_", "hazards", sf.HAZARDS), ("exposure_", "exposures", sf.EXPOSURES), ("actual_", "actual_consequences", sf.ACTUAL), ("potential_", "potential_consequences", sf.POTENTIAL)):
        cols += [f"contains('; ' || {src} || '; ', {q('; ' + label + '; ')})::int AS {pre}{k}" for k, label in table.items()]
    for k, label in sf.BARRIERS.items():
        for s, st in (("present", "[present]"), ("failed", "[failed_or_absent]")):
            cols.append(f"(len(list_filter(string_split(lower(observed_barriers), '; '), lambda x: starts_with(x, {q(label.lower())}) AND contains(x, {q(st)}))) > 0)::int AS barrier_{k}_{s}")
    cols += [f"{present(p)}::int AS {k}" for k, p in sf.CUES.items()]
    cols += [f"({' OR '.join(f'contains(t, {q(x)})' for x in v)})::int AS {k}" for k, v in sf.TERMS.items()]
    cols += [f"regexp_matches(t, {q(chr(92) + 'b' + b + chr(92) + 'b')})::int AS body_{b}_in_narrative" for b in BODY_PARTS]
    has = lambda src, label: f"contains('; ' || {src} || '; ', {q('; ' + label + '; ')})"
    cols += [f"({has('hazards', x)} AND ({' OR '.join(has('exposures', e) for e in es)}))::int AS {k}" for k, (x, es) in sf.WITH_EXPOSURE.items()]
    cols += [f"(({has('hazards', x)} OR {has('exposures', x)}) AND {has('potential_consequences', p)})::int AS {k}" for k, (x, p) in sf.WITH_POTENTIAL.items()]
    cols += [f"({has('hazards', x)} AND ({' OR '.join(f'contains(lower(observed_barriers), {q(g.lower())})' for g in gs)}))::int AS {k}" for k, (x, gs) in sf.WITH_GAP.items()]
    big = lambda p: f"list_max(list_transform(regexp_extract_all(t, {q(p)}, 1), lambda x: try_cast(replace(x, ',', '.') AS double)))"
    cols += ["length(t)::int AS narrative_chars", "len(regexp_extract_all(t, '\\b\\w+\\b'))::int AS narrative_words", f"greatest({near('t', sf.FIRE_LINE[0])}, {near('t', sf.FIRE_LINE[1])}) AS line_of_fire_distance_m",
             f"greatest({big(sf.HEIGHTS[0])}, {big(sf.HEIGHTS[1])}) AS max_height_m", f"{big(sf.VOLTS)} AS voltage_max_v", f"{big(sf.AMPS)} AS current_max_a"]
    return with_(V06, f"nt AS (SELECT report_id, {NORM} AS t FROM reports)", f"fv AS (SELECT report_id, {', '.join(cols)}, {', '.join(structured.COUNTS)} FROM flat JOIN nt USING (report_id))") + """SELECT *, (coalesce(max_height_m, 9) < 1)::int AS low_height_event,
  (coalesce(max_height_m, 0) >= 2)::int AS significant_height_event, (coalesce(voltage_max_v, 0) >= 50)::int AS high_voltage_signal FROM fv"""


def oracles() -> dict[str, str]:
    sent = "list_filter(list_transform(string_split(regexp_replace({t}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' -•' || chr(9))), lambda x: x <> '')"
    cand = candidates_cte(rule_bank.CURRENT, "predictions")
    note = "CASE event_type WHEN 'click' THEN '  ' WHEN 'view' THEN NULL ELSE ' ' || props END"
    ad = audit_ctes()
    snippet = " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN trim(substr(t, greatest(strpos(t, {q(p)}) - 40, 1), strpos(t, {q(p)}) - greatest(strpos(t, {q(p)}) - 40, 1) + {len(p)} + 40))" for p in ("ladder", "height", "guard"))
    return {
        "norm_text": with_(DOCS) + f"SELECT doc_id, {NORM} AS norm FROM docs",
        "norm_for_matching": with_(DOCS) + f"SELECT doc_id, {MATCH} AS match_key, lower(trim(source)) AS source_key FROM docs",
        "clean_fields": f"SELECT event_id, nullif(trim({note}), '') AS cleaned, coalesce(trim({note}), '') AS safe FROM events",
        "split_list": with_(REPORTS) + "SELECT report_id, risk || '|' || site || '|' || department AS items, 3 AS n FROM reports",
        "explode_tokens": with_(PREDICTIONS) + "SELECT report_id, unnest(hz) AS token FROM predictions",
        "report_id_roundtrip": with_(REPORTS) + "SELECT report_id, right(report_id, 6) AS a, right(report_id, 6) AS b FROM reports",
        "lenient_timestamp": with_(REPORTS) + "SELECT report_id, strftime(try_strptime(raw_date, '%Y-%m-%d'), '%Y-%m-%dT%H:%M:%S') AS stamp FROM reports",
        "coalesce_activity": with_(REPORTS) + "SELECT report_id, CASE WHEN risk = 'Others' THEN site ELSE risk END AS activity FROM reports",
        "join_unique": with_(REPORTS) + "SELECT report_id, risk || '; ' || site || '; ' || department AS joined FROM reports",
        "sentences": with_(DOCS, f"sn AS (SELECT doc_id, {sent.format(t=SQUEEZE)} AS l FROM docs)") + "SELECT doc_id, (generate_subscripts(l, 1) - 1)::int AS position, unnest(l) AS sentence FROM sn",
        "sentence_offsets": with_("""so AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)[^.!?\\n]+(?:[.!?]+|$)') AS hit, string_split_regex(text, '(?m)[^.!?\\n]+(?:[.!?]+|$)') AS gap FROM documents),
sp AS (SELECT doc_id, hit[i] AS s, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS o FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM so))""")
        + "SELECT doc_id, (o + length(s) - length(ltrim(s)))::int AS start, (o + length(rtrim(s)))::int AS stop, trim(s) AS sentence FROM sp WHERE trim(s) <> ''",
        "token_sets": f"SELECT doc_id, len({tokens('t')})::int AS tokens, array_to_string(list_sort({first_tokens('t')}), ' ') AS first_tokens FROM (SELECT doc_id, translate(text, {q(tb.ACCENTED)}, {q(tb.PLAIN)}) AS t FROM documents)",
        "token_overlap": with_(REPORTS, f"tk AS (SELECT report_id, {tokens(chr(34) + 'src' + chr(34))} AS a, {tokens('description')} AS b FROM (SELECT *, replace(concat_ws(' ', risk, site, department, location), '_', ' ') AS src FROM reports))")
        + f"SELECT report_id, {r9('CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a)::double END')} AS recall, {r9('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double')} AS jaccard FROM tk",
        "text_lengths": with_(REPORTS) + "SELECT report_id, length(description)::int AS chars, len(regexp_extract_all(description, '\\b\\w+\\b'))::int AS words FROM reports",
        "max_measure": with_(REPORTS) + f"SELECT report_id, list_max(list_transform(regexp_extract_all({NORM}, {q(HEIGHT)}, 1), lambda x: try_cast(replace(x, ',', '.') AS double))) AS metres FROM reports",
        "number_near_cue": with_(REPORTS, f"nt AS (SELECT report_id, {NORM} AS t FROM reports)") + f"SELECT report_id, {near('t', CUE)} AS number FROM nt",
        "context_snippet": with_(REPORTS, f"sq AS (SELECT report_id, {SQUEEZE} AS t FROM reports)") + f"SELECT report_id, CASE {snippet} END AS snippet FROM sq",
        "fabricate_ids": "SELECT doc_id, 'input_' || printf('%06d', (row_number() OVER (ORDER BY source, doc_id))) AS report_id FROM documents",
        "audit_hints": with_(ad) + "SELECT report_id, family, token_recall, audit_hint, recall_hint, count_hint FROM ad",
        "extraction_audit": with_(ad) + """SELECT family, count(*) FILTER (human <> '')::bigint AS human_present, count(*) FILTER (found <> '')::bigint AS extracted_present, count(*) FILTER (evidence <> '')::bigint AS evidence_present,
  count(*) FILTER (human <> '' AND found = '')::bigint AS missed_when_human_present, count(*) FILTER (human = '' AND found <> '')::bigint AS possible_false_positive, count(*) FILTER (human <> '' AND found <> '' AND token_recall > 0)::bigint AS partial_or_better,
  count(*) FILTER (human <> '' AND evidence = '')::bigint AS evidence_missing_when_human_present, round(100.0 * count(*) FILTER (human <> '' AND found = '') / count(*) FILTER (human <> ''), 2) AS miss_rate_pct, round(avg(token_recall) FILTER (human <> ''), 4) AS mean_token_recall FROM ad GROUP BY family""",
        "extraction_misses": with_(ad) + "SELECT report_id, count(*)::bigint AS missed_count, string_agg(family, ', ' ORDER BY family) AS missed_families FROM ad WHERE human <> '' AND found = '' GROUP BY 1",
        "features_v01": features_v01(),
        "assembled_features": with_(REPORTS) + f"SELECT report_id, 64 + 1 + {len(pathway_feature_names())} AS width FROM reports",
        "attach_embeddings": "SELECT doc_id, len(embedding)::int AS width, round(embedding[1]::double, 6) AS first, round(embedding[-1]::double, 6) AS last FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
        "stream_triage": with_(PREDICTIONS, cand) + f"""SELECT p0.report_id, p, review_priority, review_priority_reason, coalesce(c.s, '') AS rules FROM predictions p0 LEFT JOIN
  (SELECT report_id, string_agg({RENDER}, '; ' ORDER BY rn) AS s FROM candidates GROUP BY report_id) c USING (report_id)""",
        "stream_reviews": with_(REPORTS, REVIEWS) + "SELECT id, report_id, decision, trim(reviewer) AS reviewer, trim(note) AS note, created_at FROM reviews WHERE report_id IN (SELECT report_id FROM reports)",
        "stream_latest_review": with_(REVIEWS, LATEST) + "SELECT report_id, id, decision FROM latest",
        "stream_decision_counts": with_(REVIEWS, LATEST) + "SELECT decision, count(*) AS reports FROM latest GROUP BY decision",
        "report_ids_large": "SELECT doc_id, 'report_' || printf('%d', doc_id + 10000000) AS report_id, printf('%d', doc_id + 10000000) AS number FROM documents",
    }
