"""Ontology extraction oracles: sentence by key in long form, ranked by window."""

from __future__ import annotations

from hazardloom.banks import ontology_v01 as v01
from hazardloom.banks import ontology_v02 as v02
from hazardloom.banks import ontology_v03 as v03
from oracles.base import REPORTS, q, qlist, with_

SENTENCE = "(?m)[^.!?\\n]+(?:[.!?]+|$)"
OFFSETS = f"""so AS (SELECT report_id, regexp_extract_all(description, {q(SENTENCE)}) AS hit, string_split_regex(description, {q(SENTENCE)}) AS gap FROM reports),
sp AS (SELECT report_id, hit[i] AS s, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS o FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM so)),
sents AS MATERIALIZED (SELECT report_id, (o + length(s) - length(ltrim(s)))::int AS start, trim(s) AS s FROM sp WHERE trim(s) <> '')"""


def best_cte(bank=v01, source: str = "sents") -> str:
    parts = []
    for family, items in bank.ONTOLOGY.items():
        for key, (label, patterns, *prio) in items.items():
            whens = " ".join(f"WHEN regexp_matches(s, {q('(?i)' + p)}) THEN {i}" for i, p in enumerate(patterns, start=1))
            pick = f"{qlist(['(?i)' + p for p in patterns])}[k]"
            parts.append(
                f"""SELECT report_id, {prio[0] if prio else 0} AS prio, {q(family)} AS family, {q(key)} AS ontology_key, {q(label)} AS label, regexp_extract(s, {pick}) AS evidence,
  (start + length(regexp_extract(s, '(?i)^(.*?)(?:' || substr({pick}, 5) || ')', 1)))::int AS start FROM (SELECT *, CASE {whens} END AS k FROM sents) WHERE k IS NOT NULL"""
            )
    strong = " OR ".join(f"contains(lower(evidence), {q(x)})" for x in bank.STRONG)
    words = "len(regexp_extract_all(evidence, '\\S+'))"
    medium = f"{words} >= 2"
    if bank is not v01:
        strong += f" OR prio >= {bank.HIGH_PRIORITY}" + (f" OR {words} >= {bank.HIGH_WORDS}" if bank.HIGH_WORDS else "")
        medium += f" OR prio >= {bank.MEDIUM_PRIORITY}"
    return f"""raw AS (SELECT *, CASE WHEN {strong} THEN 3 WHEN {medium} THEN 2 ELSE 1 END AS rank FROM ({' UNION ALL '.join(parts)})),
best AS MATERIALIZED (SELECT report_id, family, ontology_key, label, evidence, start, (start + length(evidence))::int AS "end", ['LOW', 'MEDIUM', 'HIGH'][rank] AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY report_id, family, ontology_key ORDER BY rank DESC, length(evidence) DESC, start) AS rn FROM raw) WHERE rn = 1)"""


def rails_cte() -> str:
    parts = [f"SELECT report_id, {q(f)} AS family, {q(k)} AS ontology_key FROM reports WHERE {' OR '.join(f'contains(lower(description), {q(x)})' for x in ps)}" for (f, k), ps in v03.DROP_IF.items()]
    parts += [f"SELECT report_id, {q(f)}, {q(k)} FROM reports WHERE NOT regexp_matches(description, {q('(?i)' + p)})" for (f, k), p in v03.DROP_UNLESS.items()]
    return "rails AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def oracles() -> dict[str, str]:
    ctes = with_(REPORTS, OFFSETS, best_cte())
    keys = lambda f, ks: f"family = {q(f)} AND ontology_key IN ({', '.join(q(k) for k in ks)})"
    names = {"hazards": "hazard", "exposures": "exposure", "consequences": "consequence", "barriers": "barrier", "activities": "activity"}
    counts = ", ".join(f"count(*) FILTER (family = {q(f)})::bigint AS {n}_count" for f, n in names.items())
    return {
        "extract_v01": ctes + "SELECT * FROM best",
        "extract_v02": with_(REPORTS, OFFSETS, best_cte(v02)) + "SELECT * FROM best",
        "extract_v03": with_(REPORTS, OFFSETS, best_cte(v03), rails_cte()) + "SELECT b.* FROM best b ANTI JOIN rails USING (report_id, family, ontology_key)",
        "guard_rails": with_(REPORTS, rails_cte()) + "SELECT report_id, family || '.' || ontology_key AS dropped FROM rails",
        "extract_v01_summary": ctes + f"""SELECT report_id, {counts}, count(*) FILTER ({keys('hazards', v01.HIGH_RISK)})::bigint AS high_risk_hazard_count, count(*) FILTER ({keys('exposures', v01.DIRECT)})::bigint AS direct_exposure_count,
  count(*) FILTER ({keys('consequences', v01.SEVERE)})::bigint AS severe_consequence_signal_count, bool_or({keys('consequences', ['fatality'])}) AS has_fatality_wording, bool_or({keys('exposures', v01.DIRECT)}) AS has_direct_exposure_signal,
  bool_or(family = 'barriers') AS has_barrier_signal FROM best GROUP BY report_id""",
    }
