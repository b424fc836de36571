"""Evidence, feature, triage and rule-candidate oracles."""

from __future__ import annotations

from hazardloom.banks import evidence_v13, evidence_v14, evidence_v15, pathway_features
from hazardloom.operators import tagging, triage
from oracles.base import (
    NORM, REPORTS, alternation, evidence_list, first, joined, names_list, present, q, with_,
)


def _pathway_bank(bank):
    out = {}
    for name, (source, compatible) in bank.PATHWAYS.items():
        out[name] = (bank.EXPOSURES[source] if isinstance(source, str) else source, compatible)
    return out


def tagged_ctes(bank, extra: dict | None = None) -> str:
    """norm -> names -> signals, presence by alternation."""
    extra = extra or {}
    paths = _pathway_bank(bank)
    gated = ", ".join(
        f"CASE WHEN {present(p)} AND list_has_any(hz, {[str(c) for c in comp]}) THEN {q(n)} END"
        for n, (p, comp) in sorted(paths.items())
    )
    extras = "".join(f", {names_list(b)} AS {n}" for n, b in extra.items())
    return f"""normed AS (SELECT *, {NORM} AS t FROM reports),
tagged0 AS (SELECT *, {names_list(bank.HAZARDS)} AS hz,
  list_filter({names_list(bank.EXPOSURES)}, lambda x: x <> {q(bank.NOT_AN_EXPOSURE)}) AS ex,
  {names_list(bank.CONTEXT)} AS cx{extras} FROM normed),
tagged AS (SELECT *, list_filter([{gated}], lambda x: x IS NOT NULL) AS pw FROM tagged0),
signals AS (SELECT *, (len(hz) > 0)::int AS hazard_signal, (len(ex) > 0)::int AS exposure_signal,
  (len(pw) > 0)::int AS pathway_signal,
  (len(hz) > 0)::int + (len(ex) > 0)::int + (len(pw) > 0)::int AS pathway_signal_strength,
  (len(hz) > 0 AND len(ex) > 0 AND len(pw) > 0)::int AS complete_pathway FROM tagged)"""


STATUS_RULES = [
    ("list_contains(cx, 'no_person_affected')", "CONTEXT_AGAINST_SIF", "against"),
    ("len(sv) > 0 AND len(pw) > 0", "SUFFICIENT_CONTEXT", "severe"),
    ("len(pw) > 0 AND len(mi) > 0", "CONTEXT_LIMITED", "minor"),
    ("len(pw) > 0 AND len(ex) > 0", "SUFFICIENT_CONTEXT", "pathway"),
    ("len(hz) > 0 AND len(ex) > 0", "CONTEXT_LIMITED", "no_pathway"),
    ("len(hz) > 0", "UNKNOWN", "hazard"),
    ("len(ex) > 0", "UNKNOWN", "exposure"),
]


def _case(rules, index: int, last: str) -> str:
    whens = " ".join(f"WHEN {r[0]} THEN {q(r[index])}" for r in rules)
    return f"CASE {whens} ELSE {q(last)} END"


_reasons = [(c, s, tagging.CONTEXT_REASONS[k]) for c, s, k in STATUS_RULES]

V15 = (
    REPORTS
    + ",\n"
    + tagged_ctes(evidence_v15, {"mi": evidence_v15.MINOR_CONTEXT, "sv": evidence_v15.SEVERE_CONTEXT})
    + f""",
evidence AS MATERIALIZED (SELECT *, {joined('hz')} AS hazards, {joined('ex')} AS exposures, {joined('pw')} AS pathways,
  {joined('cx')} AS context_flags,
  {_case(_reasons, 1, 'UNKNOWN')} AS sif_context_status,
  {_case(_reasons, 2, tagging.CONTEXT_REASONS['nothing'])} AS sif_context_reason,
  CASE WHEN pathway_signal_strength = 3 AND list_contains(cx, 'no_person_affected') THEN 'NONE'
    ELSE ['NONE', 'WEAK', 'PARTIAL', 'SUPPORTED'][pathway_signal_strength + 1] END AS pathway_assessment
  FROM signals)"""
)

POLICY_V14 = [
    ("p >= 0.9", "P1", "VERY_HIGH_MODEL_SCORE"),
    ("p >= 0.75 AND c", "P1", "HIGH_MODEL_PLUS_COMPLETE_PATHWAY"),
    ("p < 0.5 AND c", "P1", "MODEL_MISS_PLUS_COMPLETE_PATHWAY"),
    ("p >= 0.75", "P2", "HIGH_MODEL_SCORE_REVIEW"),
    ("p >= 0.5 AND (e OR w)", "P2", "MODERATE_HIGH_MODEL_PLUS_EXPLICIT_MECHANISM"),
    ("p >= 0.5", "P3", "MODERATE_MODEL_SCORE"),
    ("p >= 0.3 AND (h OR e OR w)", "P3", "LOWER_MODEL_PLUS_PRECURSOR_SIGNAL"),
    ("h OR e OR w", "P4", "LOW_MODEL_PLUS_PRECURSOR_SIGNAL"),
]
POLICY_V13 = [
    ("p >= 0.8 AND (e OR w OR c OR pathway_signal_strength >= 2)", "P1", "HIGH_MODEL_PLUS_EXPLICIT_PRECURSOR_EVIDENCE"),
    ("p < 0.5 AND c", "P1", "LOW_MODEL_PLUS_COMPLETE_PATHWAY_REVIEW"),
    ("p >= 0.75", "P2", "HIGH_MODEL_WEAK_OR_MISSING_EVIDENCE"),
    ("c", "P3", "COMPLETE_PATHWAY_REVIEW"),
    ("p >= 0.5 AND (h OR e OR w)", "P3", "MODERATE_MODEL_PLUS_EXPLICIT_EVIDENCE"),
    ("h OR e OR w", "P4", "LOW_MODEL_PLUS_SOME_PRECURSOR_SIGNAL"),
]
BOOLS = "hazard_signal = 1 AS h, exposure_signal = 1 AS e, pathway_signal = 1 AS w, complete_pathway = 1 AS c"

PREDICTIONS = (
    V15
    + f""",
flagged AS (SELECT *, {BOOLS} FROM evidence),
predictions AS MATERIALIZED (SELECT *, {_case(POLICY_V14, 1, 'P5')} AS review_priority,
  {_case(POLICY_V14, 2, 'LOW_MODEL_NO_PRECURSOR_SIGNAL')} AS review_priority_reason FROM flagged)"""
)

SIGNALS = "hazard_signal, exposure_signal, pathway_signal, pathway_signal_strength, complete_pathway"


def _terms_sql(bank) -> str:
    paths = {n: p for n, (p, _) in _pathway_bank(bank).items()}
    return f"""SELECT report_id, {joined('hz')} AS hazards, {joined('ex')} AS exposures, {joined('pw')} AS pathways,
  {joined(evidence_list(bank.HAZARDS, 'hz'))} AS hazard_evidence,
  {joined(evidence_list(bank.EXPOSURES, 'ex'))} AS exposure_evidence,
  {joined(evidence_list(paths, 'pw'))} AS pathway_evidence"""


def _older(bank, flags: str) -> str:
    ctes = REPORTS + ",\n" + tagged_ctes(bank)
    return (
        with_(ctes)
        + _terms_sql(bank)
        + f""", {joined('cx')} AS {flags}, {SIGNALS},
  CASE WHEN list_contains(cx, 'no_person_affected') AND pathway_signal_strength >= 2 THEN 'WEAK'
    ELSE ['NONE', 'WEAK', 'PARTIAL', 'SUPPORTED'][pathway_signal_strength + 1] END AS pathway_assessment FROM signals"""
    )


def feature_ctes() -> str:
    b = pathway_features
    cols = [f"{present(p)}::int AS path_hazard_{k}" for k, p in b.HAZARDS.items()]
    cols += [f"{present(p)}::int AS path_exposure_{k}" for k, p in b.EXPOSURES.items()]
    cols += [f"{present(p)}::int AS pathway_{k}" for k, p in b.PATHWAYS.items()]
    hs = " + ".join(f"path_hazard_{k}" for k in b.HAZARDS)
    es = " + ".join(f"path_exposure_{k}" for k in b.EXPOSURES)
    ps = " + ".join(f"pathway_{k}" for k in b.PATHWAYS)
    complete = ", ".join(
        f"(path_hazard_{h} + path_exposure_{e} + pathway_{p} = 3)::int AS {n}" for n, (h, e, p) in b.COMPLETE.items()
    )
    return f"""feat0 AS (SELECT report_id, p, label, {', '.join(cols)} FROM (SELECT *, {NORM} AS t FROM reports)),
feat1 AS (SELECT *, {hs} AS path_hazard_count, {es} AS path_exposure_count, {ps} AS pathway_count FROM feat0),
feat AS (SELECT *, (path_hazard_count > 0 AND path_exposure_count > 0)::int AS path_hazard_exposure,
  (path_hazard_count > 0 AND pathway_count > 0)::int AS path_hazard_pathway,
  (path_exposure_count > 0 AND pathway_count > 0)::int AS path_exposure_pathway,
  (path_hazard_count > 0 AND path_exposure_count > 0 AND pathway_count > 0)::int AS path_complete, {complete},
  (path_exposure_line_of_fire = 1 AND pathway_struck_by_projectile + path_hazard_vehicle + path_hazard_dropped_object > 0)::int AS path_line_fire
  FROM feat1)"""


FEATURES = feature_ctes()


def _training_evidence() -> str:
    b = pathway_features

    def names(prefix, cats):
        return joined(
            "list_filter([" + ", ".join(f"CASE WHEN {prefix}{k} = 1 THEN {q(k)} END" for k in sorted(cats)) + "], lambda x: x IS NOT NULL)"
        )

    strength = "(path_hazard_count > 0)::int + (path_exposure_count > 0)::int + (pathway_count > 0)::int"
    return (
        with_(REPORTS, FEATURES)
        + f"""SELECT report_id, {names('path_hazard_', b.HAZARDS)} AS hazards, {names('path_exposure_', b.EXPOSURES)} AS exposures,
  {names('pathway_', b.PATHWAYS)} AS pathways, {strength} AS pathway_signal_strength,
  ['NONE', 'WEAK', 'PARTIAL', 'SUPPORTED'][{strength} + 1] AS pathway_assessment FROM feat"""
    )


def _reconstructed() -> str:
    b = evidence_v15
    hz = list(b.HAZARDS)
    ex = [e for e in b.EXPOSURES if e != b.NOT_AN_EXPOSURE]
    pw = list(b.PATHWAYS)
    have = {f"path_hazard_{k}": f"list_contains(hz, {q(k)})" for k in hz}
    have |= {f"path_exposure_{k}": f"list_contains(ex, {q(k)})" for k in ex}
    have |= {f"pathway_{k}": f"list_contains(pw, {q(k)})" for k in pw}
    both = {
        "path_hazard_exposure": "len(hz) > 0 AND len(ex) > 0",
        "path_hazard_pathway": "len(hz) > 0 AND len(pw) > 0",
        "path_exposure_pathway": "len(ex) > 0 AND len(pw) > 0",
        "path_complete": "len(hz) > 0 AND len(ex) > 0 AND len(pw) > 0",
        "path_electrical_complete": "list_contains(hz, 'electrical') AND list_contains(ex, 'electrical_exposure') AND list_contains(pw, 'electrical_contact')",
        "path_chemical_complete": "list_contains(hz, 'chemical') AND list_contains(ex, 'chemical_exposure') AND list_contains(pw, 'chemical_release_exposure')",
        "path_fall_complete": "list_contains(hz, 'fall_height') AND list_contains(ex, 'fall_exposure') AND list_contains(pw, 'fall_from_height')",
        "path_vehicle_complete": "list_contains(hz, 'vehicle') AND list_contains(ex, 'vehicle_exposure') AND list_contains(pw, 'vehicle_person_collision')",
        "path_caught_complete": "list_contains(hz, 'mechanical') AND list_contains(ex, 'caught_between_exposure') AND list_contains(pw, 'caught_crush')",
        "path_line_fire": "list_contains(ex, 'line_of_fire') AND (list_contains(pw, 'struck_by_projectile') OR list_contains(hz, 'vehicle') OR list_contains(hz, 'stored_projectile'))",
    }
    counts = {"path_hazard_count": "len(hz)", "path_exposure_count": "len(ex)", "pathway_count": "len(pw)"}
    cols = []
    for n in tagging.pathway_feature_names():
        if n in have or n in both:
            cols.append(f"({have.get(n) or both[n]})::int AS {n}")
        elif n in counts:
            cols.append(f"{counts[n]}::int AS {n}")
        else:
            cols.append(f"0 AS {n}")
    return with_(V15) + f"SELECT report_id, {', '.join(cols)} FROM evidence"


CONFLICT = """CASE WHEN y = 0 AND p >= 0.75 THEN 'HIGH_SCORE_FALSE_POSITIVE' WHEN y = 0 AND p >= 0.5 THEN 'FALSE_POSITIVE'
  WHEN y = 1 AND p < 0.5 AND pathway_signal = 1 AND exposure_signal = 1 THEN 'FALSE_NEGATIVE_WITH_EVIDENCE'
  WHEN y = 1 AND p < 0.5 THEN 'FALSE_NEGATIVE' ELSE 'NONE' END"""

CONFLICTED = PREDICTIONS + f""",
truthed AS (SELECT *, CASE label WHEN 'YES' THEN 1 WHEN 'NO' THEN 0 END AS y FROM predictions),
conflicted AS (SELECT *, {CONFLICT} AS conflict_type FROM truthed)"""


def _reading(texts, old: bool) -> str:
    if old:
        rules = [
            ("y = 0 AND p >= 0.75", texts["high_no"]),
            ("y = 1 AND p < 0.5 AND pathway_signal_strength >= 2", texts["low_yes"]),
            ("pathway_assessment = 'SUPPORTED'", texts["SUPPORTED"]),
            ("pathway_assessment = 'PARTIAL'", texts["PARTIAL"]),
            ("pathway_assessment = 'WEAK'", texts["WEAK"]),
        ]
        return _case(rules, 1, texts["NONE"])
    rules = [
        ("conflict_type = 'HIGH_SCORE_FALSE_POSITIVE'", texts["high_no"]),
        ("conflict_type = 'FALSE_NEGATIVE_WITH_EVIDENCE'", texts["missed"]),
        ("sif_context_status = 'CONTEXT_AGAINST_SIF'", texts["against"]),
        ("sif_context_status = 'CONTEXT_LIMITED'", texts["limited"]),
        ("sif_context_status = 'SUFFICIENT_CONTEXT'", texts["sufficient"]),
        ("p >= 0.5", texts["ranked"]),
    ]
    return _case(rules, 1, texts["low"])


EV_PRIORITY = """CASE WHEN conflict_type IN ('HIGH_SCORE_FALSE_POSITIVE', 'FALSE_NEGATIVE_WITH_EVIDENCE') THEN 'P1'
  WHEN p >= 0.8 THEN 'P2' WHEN p >= 0.5 OR complete_pathway = 1 THEN 'P3' WHEN pathway_signal_strength > 0 THEN 'P4' ELSE 'P5' END"""

V12_CONFLICTS = """array_to_string(list_filter([
  CASE WHEN p >= 0.75 AND sif_context_status IN ('UNKNOWN', 'CONTEXT_LIMITED') THEN 'HIGH_SCORE_MODEL_CONFLICT' END,
  CASE WHEN p < 0.2 AND pathway_signal = 1 AND exposure_signal = 1 THEN 'MODEL_MISS_WITH_EXPLICIT_EVIDENCE' END,
  CASE WHEN p < 0.5 AND complete_pathway = 1 THEN 'LOW_SCORE_MODEL_MISS_WITH_EXPLICIT_PATHWAY' END], lambda x: x IS NOT NULL), '|')"""


def candidates_cte(rules: dict, source: str, name: str = "candidates", sort_terms: bool = True, keep: int = 3) -> str:
    """Long form: one row per report and rule with a score, ranked by window."""
    parts = []
    for rule, spec in rules.items():
        terms = sorted(set(spec["terms"])) if sort_terms else spec["terms"]
        matched = "list_filter([" + ", ".join(f"CASE WHEN contains(low, {q(x)}) THEN {q(x)} END" for x in terms) + "], lambda x: x IS NOT NULL)"
        cues = [f"contains({c}, {q(x)})" for c in ("hazards", "exposures", "pathways") for x in spec.get(c, [])]
        cues += [f"contains(low, {q(x)})" for x in spec.get("words", [])]
        parts.append(f"SELECT report_id, {q(rule)} AS rule, {matched} AS terms, ({' OR '.join(cues)}) AS cue FROM lowered")
    return f"""lowered AS (SELECT report_id, lower(description) AS low, hazards, exposures, pathways FROM {source}),
cand0 AS ({' UNION ALL '.join(parts)}),
cand1 AS (SELECT *, round(least(1.0::double, least(0.6::double, 0.2::double * len(terms)) + CASE WHEN cue THEN 0.4::double ELSE 0.0::double END), 4) AS score FROM cand0),
cand2 AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, rule) AS rn FROM cand1 WHERE score > 0),
{name} AS (SELECT report_id, rule, score, rn, list_slice(terms, 1, 8) AS terms FROM cand2 WHERE rn <= {keep})"""


RENDER = "rule || '=' || score::decimal(6,4)::varchar || '[' || array_to_string(terms, ',') || ']'"


def _candidates(rules, sort_terms=True) -> str:
    return (
        with_(V15, candidates_cte(rules, "evidence", sort_terms=sort_terms))
        + f"""SELECT e.report_id, coalesce(c.s, '') AS rule_candidates FROM evidence e LEFT JOIN
  (SELECT report_id, string_agg({RENDER}, '; ' ORDER BY rn) AS s FROM candidates GROUP BY report_id) c USING (report_id)"""
    )


def _gated() -> str:
    b = evidence_v15
    paths = _pathway_bank(b)
    all_open = sorted(b.HAZARDS)
    gated = ", ".join(
        f"CASE WHEN {present(p)} AND list_has_any(hz, {all_open if n == 'chemical_release_exposure' else [str(c) for c in comp]}) THEN {q(n)} END"
        for n, (p, comp) in sorted(paths.items())
    )
    return (
        with_(REPORTS, tagged_ctes(b), f"""opened AS (SELECT *, list_filter([{gated}], lambda x: x IS NOT NULL) AS pw2 FROM tagged),
kept AS (SELECT *, CASE WHEN list_contains(cx, 'water_mud') AND NOT list_contains(hz, 'chemical') AND NOT list_contains(ex, 'chemical_exposure')
  THEN list_filter(pw2, lambda x: x <> 'chemical_release_exposure') ELSE pw2 END AS pw3 FROM opened)""")
        + f"""SELECT report_id, {joined('pw3')} AS pathways, {joined(evidence_list({n: p for n, (p, _) in paths.items()}, 'pw3'))} AS pathway_evidence,
  len(pw3)::int AS pathway_count FROM kept"""
    )


def oracles() -> dict[str, str]:
    from hazardloom.banks import rules

    b15 = evidence_v15
    minor = "list_filter([" + ", ".join(f"CASE WHEN list_contains(mi, {q(c)}) THEN {q(c + ': ')} || {first(p)} END" for c, p in sorted(b15.MINOR_CONTEXT.items())) + "], lambda x: x IS NOT NULL)"
    severe = "list_filter([" + ", ".join(f"CASE WHEN list_contains(sv, {q(c)}) THEN {q(c + ': ')} || {first(p)} END" for c, p in sorted(b15.SEVERE_CONTEXT.items())) + "], lambda x: x IS NOT NULL)"
    haz = b15.HAZARDS
    counts = " + ".join(f"regexp_matches(t, {q(p)})::int" for p in haz["chemical"])
    terms = "list_filter([" + ", ".join(f"regexp_extract(t, {q(p)})" for p in haz["chemical"]) + "], lambda x: x <> '')"
    norm_cte = f"normed AS (SELECT *, {NORM} AS t FROM reports)"
    return {
        "evidence_v15": with_(V15)
        + f"SELECT report_id, hazards, exposures, pathways, context_flags, {SIGNALS}, sif_context_status, sif_context_reason, pathway_assessment FROM evidence",
        "evidence_v15_terms": with_(V15) + _terms_sql(b15) + f", {joined(minor)} AS minor_context, {joined(severe)} AS severe_context FROM evidence",
        "evidence_v14": _older(evidence_v14, "context_flags"),
        "evidence_v13": _older(evidence_v13, "safe_context_flags"),
        "pathway_gating": _gated(),
        "pathway_features": with_(REPORTS, FEATURES) + f"SELECT report_id, {', '.join(tagging.pathway_feature_names())} FROM feat",
        "training_evidence": _training_evidence(),
        "reconstructed_features": _reconstructed(),
        "tag_any": with_(REPORTS, norm_cte) + f"SELECT report_id, regexp_matches(t, {q(alternation(haz['vehicle']))})::int AS vehicle, regexp_matches(t, {q(alternation(haz['thermal']))})::int AS thermal FROM normed",
        "tag_first_evidence": with_(REPORTS, norm_cte) + f"SELECT report_id, {first(haz['fall_height'])} AS fall_evidence, {first(haz['chemical'])} AS chemical_evidence FROM normed",
        "tag_all_terms": with_(REPORTS, norm_cte) + f"SELECT report_id, array_to_string({terms}, ' | ') AS chemical_terms FROM normed",
        "tag_pattern_counts": with_(REPORTS, norm_cte) + f"SELECT report_id, ({counts})::int AS chemical_patterns FROM normed",
        "tag_categories": with_(REPORTS, norm_cte) + f"SELECT report_id, unnest(l) AS category FROM (SELECT report_id, {names_list(haz)} AS l FROM normed)",
        "triage_v14": with_(PREDICTIONS) + "SELECT report_id, p, review_priority, review_priority_reason FROM predictions",
        "triage_v13": with_(V15, f"flagged AS (SELECT *, {BOOLS} FROM evidence)")
        + f"SELECT report_id, p, {_case(POLICY_V13, 1, 'P5')} AS review_priority, {_case(POLICY_V13, 2, 'LOW_MODEL_NO_PRECURSOR_EVIDENCE')} AS review_priority_reason FROM flagged",
        "triage_v12": with_(V15, f"v12 AS (SELECT *, {V12_CONFLICTS} AS model_evidence_conflicts FROM evidence)")
        + """SELECT report_id, p, model_evidence_conflicts,
  CASE WHEN model_evidence_conflicts <> '' THEN 'P1' WHEN p >= 0.8 THEN 'P2' WHEN p >= 0.5 OR complete_pathway = 1 THEN 'P3' WHEN pathway_signal_strength > 0 THEN 'P4' ELSE 'P5' END AS review_priority,
  CASE WHEN model_evidence_conflicts <> '' THEN 'HSSE_REVIEW_REQUIRED' WHEN p >= 0.5 OR complete_pathway = 1 THEN 'PRIORITIZE_FOR_HSSE_REVIEW' ELSE 'LOWER_PRIORITY_RETAIN_FOR_REVIEW' END AS review_decision FROM v12""",
        "evidence_priority": with_(CONFLICTED)
        + f"""SELECT report_id, {EV_PRIORITY} AS priority_v15,
  CASE WHEN p >= 0.8 AND complete_pathway = 1 THEN 'P1' WHEN p >= 0.8 AND pathway_signal_strength > 0 THEN 'P2' WHEN p >= 0.5 THEN 'P3' WHEN p >= 0.25 THEN 'P4' ELSE 'P5' END AS priority_v14,
  CASE WHEN p >= 0.8 AND complete_pathway = 1 THEN 'P1' WHEN p >= 0.8 AND pathway_signal_strength > 0 THEN 'P2' WHEN p >= 0.5 AND pathway_signal_strength > 0 THEN 'P3' WHEN p >= 0.25 THEN 'P4' ELSE 'P5' END AS priority_v13 FROM conflicted""",
        "conflict_type": with_(CONFLICTED) + "SELECT report_id, p, label, conflict_type FROM conflicted WHERE label IS NOT NULL",
        "interpretation": with_(CONFLICTED)
        + f"SELECT report_id, {_reading(triage.READING_V15, False)} AS reading_v15, {_reading(triage.READING_V14, True)} AS reading_v14, {_reading(triage.READING_V13, True)} AS reading_v13 FROM conflicted",
        "lsr_candidates": _candidates(rules.CURRENT),
        "lsr_candidates_exact": _candidates(rules.EXACT),
        "lsr_candidates_v10": _candidates(rules.FIRST, sort_terms=False),
        "lsr_counts": with_(V15, candidates_cte(rules.CURRENT, "evidence")) + "SELECT rule, count(*)::bigint AS reports FROM candidates GROUP BY rule",
        "prediction_records": with_(PREDICTIONS, candidates_cte(rules.CURRENT, "predictions"))
        + f"""SELECT p0.report_id, round(p, 6) AS probability, p >= 0.5 AS flagged, review_priority, review_priority_reason, hazards, exposures, pathways,
  sif_context_status, pathway_assessment, complete_pathway, coalesce(c.s, '') AS rules FROM predictions p0 LEFT JOIN
  (SELECT report_id, string_agg({RENDER}, '; ' ORDER BY rn) AS s FROM candidates GROUP BY report_id) c USING (report_id)""",
    }
