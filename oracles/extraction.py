"""Extraction oracles in long form: one row per occurrence, ranked and folded by windows and aggregates."""

from __future__ import annotations

from hazardloom.banks import extraction_v04 as v04
from hazardloom.banks import extraction_v05 as v05
from hazardloom.banks import extraction_v06 as v06
from hazardloom.banks import rules as rule_bank
from hazardloom.operators import reasoning as rs
from oracles.base import REPORTS, SQUEEZE, q, qlist, with_

BASE = f"base AS (SELECT report_id, {SQUEEZE} AS tx, lower({SQUEEZE}) AS lw FROM reports)"


def hits(name: str, bank, cap: int, source: str = "base") -> str:
    parts = " UNION ALL ".join(
        f"SELECT report_id, {k} AS k, {q(label)} AS label, regexp_extract_all(tx, {q('(?i)' + p)}) AS l FROM {source}"
        for k, (label, p) in enumerate(bank)
    )
    return f"""{name}_raw AS (SELECT report_id, k, label, unnest(l) AS ev, generate_subscripts(l, 1) AS i FROM ({parts})),
{name}_first AS (SELECT report_id, k, label, min(i) AS i, arg_min(trim(ev), i) AS ev FROM {name}_raw GROUP BY report_id, k, label, lower(trim(ev))),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY k, i) AS rn FROM {name}_first) WHERE rn <= {cap})"""


def longest(name: str) -> str:
    return f"""{name}_best AS (SELECT report_id, label, k AS rn, ev FROM (SELECT *, row_number() OVER
  (PARTITION BY report_id, label ORDER BY length(ev) DESC, rn) AS pick FROM {name}) WHERE pick = 1)"""


def uniq(name: str, column: str, out: str, sep: str = "; ") -> str:
    """Case-insensitive distinct join in rank order."""
    return f"""{out} AS (SELECT report_id, string_agg(v, {q(sep)} ORDER BY rn) AS s FROM (
  SELECT report_id, arg_min({column}, rn) AS v, min(rn) AS rn FROM {name} WHERE trim({column}) <> '' GROUP BY report_id, lower({column})) GROUP BY report_id)"""


def plain(name: str, column: str, out: str) -> str:
    return f"{out} AS (SELECT report_id, string_agg({column}, '; ' ORDER BY rn) AS s, count(*) AS n FROM {name} GROUP BY report_id)"


def barriers_v04() -> str:
    parts = []
    for k, (label, p) in enumerate(v04.FAILURES):
        parts.append(f"SELECT report_id, {k} AS rn, {q(label)} AS label, 'failed_or_absent' AS status, regexp_extract(lw, {q(p)}) AS ev FROM base WHERE regexp_matches(lw, {q(p)})")
    failed = dict(v04.FAILURES)
    for k, (label, p) in enumerate(v04.BARRIERS):
        unless = f" AND NOT regexp_matches(lw, {q(failed[label])})" if label in failed else ""
        window = f"substr(lw, greatest(pos_ - 70, 1), pos_ - greatest(pos_ - 70, 1) + length(ev) + 70)"
        parts.append(
            f"""SELECT report_id, {100 + k} AS rn, {q(label)} AS label,
  CASE WHEN regexp_matches({window}, {q(v04.NEGATION)}) THEN 'failed_or_absent' ELSE 'present' END AS status, ev FROM (
  SELECT report_id, lw, regexp_extract(tx, {q('(?i)' + p)}) AS ev, length(regexp_extract(lw, {q('^(.*?)(?:' + p + ')')}, 1)) + 1 AS pos_ FROM base
  WHERE regexp_matches(lw, {q(p)}){unless})"""
        )
    return "bar AS (" + " UNION ALL ".join(parts) + ")"


def _in(labels) -> str:
    return "(" + ", ".join(q(x) for x in labels) + ")"


def v04_ctes() -> str:
    direct = f"""exd AS (SELECT b.report_id, 1000 AS rn, 'Direct worker exposure' AS label, regexp_extract(lw, {q(v04.HUMAN + '.{0,80}' + v04.INJURY)}) AS ev FROM base b
  WHERE regexp_matches(lw, {q(v04.HUMAN + '.{0,80}' + v04.INJURY)}) AND report_id NOT IN (SELECT report_id FROM ex WHERE label = 'Direct worker exposure'))"""
    caught = r"\b(?:caught[- ]between|imprisoned between|crushed between|finger.*?(?:caught|trapped|imprisoned)|hand.*?(?:caught|trapped|imprisoned))\b"
    squeezed = f"""exc AS (SELECT report_id, 1001 AS rn, 'Caught-between / pinch exposure' AS label, regexp_extract(tx, {q('(?i)' + caught)}) AS ev FROM base
  WHERE regexp_matches(lw, {q(caught)}) AND report_id NOT IN (SELECT report_id FROM ex WHERE label = 'Caught-between / pinch exposure'))"""
    return ",\n".join(
        [
            REPORTS, BASE, hits("hz", v04.HAZARDS, 8), hits("ex", v04.EXPOSURES, 8), hits("co", v04.CONSEQUENCES, 10),
            hits("ac", v04.ACTIVITIES, 5), barriers_v04(), direct, squeezed,
            "exall AS (SELECT report_id, rn, label, ev FROM ex UNION ALL SELECT * FROM exd UNION ALL SELECT * FROM exc)",
            "bart AS (SELECT *, label || ' [' || status || ']' AS txt FROM bar)",
            f"""sig AS (SELECT b.report_id, regexp_matches(lw, {q(v04.FATALITY)}) AS fatal,
  regexp_matches(lw, {q(v04.CAUGHT)}) OR report_id IN (SELECT report_id FROM exall WHERE label = 'Caught-between / pinch exposure') AS caught,
  report_id IN (SELECT report_id FROM exall WHERE label IN {_in(v04.DIRECT_EXPOSURE)}) AS direct,
  report_id IN (SELECT report_id FROM co WHERE label IN {_in(v04.SEVERE)}) AS severe,
  report_id IN (SELECT report_id FROM hz WHERE label IN {_in(v04.HIGH_ENERGY)}) AS energetic,
  report_id IN (SELECT report_id FROM bar WHERE status = 'failed_or_absent') AS gap FROM base b)""",
        ]
    )


SIG_COLS = """fatal AS has_fatality_evidence, caught AS has_caught_between_evidence, direct AS has_direct_exposure_evidence,
  severe AS has_severe_consequence_signal, energetic AS has_high_energy_signal, gap AS has_barrier_failure_signal,
  round(least(1.0::double, (CASE WHEN energetic THEN 0.3::double ELSE 0 END) + (CASE WHEN direct THEN 0.25::double ELSE 0 END) + (CASE WHEN caught THEN 0.2::double ELSE 0 END)
  + (CASE WHEN severe OR fatal THEN 0.25::double ELSE 0 END) + (CASE WHEN gap THEN 0.1::double ELSE 0 END)), 4) AS sif_precursor_signal_score"""


def extract_v04_sql() -> str:
    fams = [("hz", "hazards", "hazard"), ("exall", "exposures", "exposure"), ("co", "consequences", "consequence"), ("ac", "activities", "activity")]
    ctes, cols, joins = [v04_ctes()], [], []
    for src, many, one in fams + [("bart", "barriers", "barrier")]:
        label = "txt" if src == "bart" else "label"
        ctes += [uniq(src, label, f"{src}_l"), uniq(src, "ev", f"{src}_e"), f"{src}_n AS (SELECT report_id, count(*)::int AS n FROM {src} GROUP BY report_id)"]
        cols.append(f"coalesce({src}_l.s, '') AS {many}, coalesce({src}_e.s, '') AS {one}_evidence, coalesce({src}_n.n, 0) AS {one}_count")
        joins += [f"LEFT JOIN {src}_{x} USING (report_id)" for x in "len"]
    return with_(*ctes) + f"SELECT sig.report_id, {', '.join(cols)}, {SIG_COLS} FROM sig {' '.join(joins)}"


FAMS = [
    ("hz", "hazards", "hazard"), ("ex", "exposures", "exposure"), ("act", "actual_consequences", "actual_consequence"),
    ("pot", "potential_consequences", "potential_consequence"), ("ac", "activities", "activity"),
]


def gaps(bank, offset: int) -> list[str]:
    return [
        f"SELECT report_id, {offset + k} AS rn, {q(n)} AS label, 'failed_or_absent' AS status, trim(regexp_extract(tx, {q('(?i)' + p)})) AS ev FROM base WHERE regexp_matches(lw, {q(p)})"
        for k, (n, p) in enumerate(bank)
    ]


def flat_sql(ctes: list[str], suffix: dict[str, str]) -> str:
    out, cols, joins = list(ctes), [], []
    for src, many, one in FAMS:
        name = suffix.get(src, src)
        out += [plain(name, "label", f"{src}_l"), plain(name, "ev", f"{src}_e")]
        cols.append(f"coalesce({src}_l.s, '') AS {many}, coalesce({src}_e.s, '') AS {one}_evidence, coalesce({src}_l.n, 0)::int AS {one}_count")
        joins += [f"LEFT JOIN {src}_{x} USING (report_id)" for x in "le"]
    out += ["bart AS (SELECT *, label || ' [' || status || ']' AS txt FROM bar)", plain("bart", "txt", "bar_l"), plain("bart", "ev", "bar_e")]
    cols.append("coalesce(bar_l.s, '') AS observed_barriers, coalesce(bar_e.s, '') AS barrier_evidence, coalesce(bar_l.n, 0)::int AS barrier_count")
    joins += ["LEFT JOIN bar_l USING (report_id)", "LEFT JOIN bar_e USING (report_id)"]
    out.append(f"flat AS (SELECT b.report_id, {', '.join(cols)} FROM base b {' '.join(joins)})")
    return ",\n".join(out)


def v05_ctes() -> str:
    banks = [("hz", v05.HAZARDS), ("ex", v05.EXPOSURES), ("act", v05.ACTUAL), ("pot", v05.POTENTIAL), ("ac", v05.ACTIVITIES), ("pre", v05.BARRIERS)]
    ctes = [REPORTS, BASE, *[hits(n, b, 8) for n, b in banks]]
    present = "SELECT report_id, 100 + min(rn) AS rn, label, 'present' AS status, arg_min(ev, rn) AS ev FROM pre GROUP BY report_id, label"
    ctes.append("bar AS (" + " UNION ALL ".join([*gaps(v05.GAPS, 0), present]) + ")")
    return flat_sql(ctes, {})


def potentials() -> str:
    parts = []
    for k, (label, a, b) in enumerate(v06.POTENTIAL):
        pos = lambda p: f"length(regexp_extract(lw, {q('^(.*?)(?:' + p + ')')}, 1)) + 1"
        ln = lambda p: f"length(regexp_extract(lw, {q(p)}))"
        parts.append(
            f"""SELECT report_id, {k} AS rn, {q(label)} AS label, trim(substr(tx, greatest(least(pa, pb) - 50, 1), greatest(pa + la, pb + lb) + 90 - greatest(least(pa, pb) - 50, 1))) AS ev
  FROM (SELECT report_id, tx, {pos(a)} AS pa, {ln(a)} AS la, {pos(b)} AS pb, {ln(b)} AS lb FROM base WHERE regexp_matches(lw, {q(a)}) AND regexp_matches(lw, {q(b)}))"""
        )
    return "pot AS (" + " UNION ALL ".join(parts) + ")"


def v06_ctes() -> str:
    banks = [("hz", v06.HAZARDS), ("ex", v06.EXPOSURES), ("act", v06.ACTUAL), ("ac", v06.ACTIVITIES)]
    ctes = [REPORTS, BASE]
    for n, b in banks:
        ctes += [hits(n, b, 20), longest(n)]
    present = [
        f"SELECT report_id, {100 + k} AS rn, {q(n)} AS label, 'present' AS status, trim(regexp_extract(tx, {q('(?i)' + p)})) AS ev FROM base WHERE regexp_matches(lw, {q(p)})"
        for k, (n, p) in enumerate(v06.BARRIERS)
    ]
    ctes += [potentials(), "bar AS (" + " UNION ALL ".join([*gaps(v06.GAPS, 0), *present]) + ")"]
    return flat_sql(ctes, {n: f"{n}_best" for n, _ in banks})


V06 = v06_ctes()

SPLIT = lambda c: f"list_filter(string_split({c}, '; '), lambda x: x <> '')"
PREPARED = V06 + f""",
barlong AS (SELECT report_id, label, status FROM bar),
prep AS (SELECT f.*, {SPLIT('hazards')} AS h, {SPLIT('exposures')} AS e, {SPLIT('actual_consequences')} AS a, {SPLIT('potential_consequences')} AS pt,
  {SPLIT('activities')} AS ac_, hazard_evidence || ' ' || exposure_evidence || ' ' || actual_consequence_evidence || ' ' || potential_consequence_evidence || ' ' || barrier_evidence || ' ' || activity_evidence AS evidence_text,
  coalesce(bp.s, '') AS barriers_present, coalesce(bf.s, '') AS barriers_failed FROM flat f
  LEFT JOIN (SELECT report_id, string_agg(DISTINCT label, '; ' ORDER BY label) AS s FROM barlong WHERE status = 'present' GROUP BY report_id) bp USING (report_id)
  LEFT JOIN (SELECT report_id, string_agg(DISTINCT label, '; ' ORDER BY label) AS s FROM barlong WHERE status <> 'present' GROUP BY report_id) bf USING (report_id))"""


def label_rules(rules, needs: bool) -> str:
    parts = []
    for k, (name, r) in enumerate(rules.items()):
        terms = [f"CASE WHEN list_contains(h, {q(x)}) THEN 0.35::double ELSE 0 END" for x in r.get("hazards", [])]
        terms += [f"CASE WHEN list_contains(e, {q(x)}) THEN 0.35::double ELSE 0 END" for x in r.get("exposures", [])]
        terms += [f"CASE WHEN list_contains(ac_, {q(x)}) THEN 0.2::double ELSE 0 END" for x in r.get("activities", [])]
        terms += [f"CASE WHEN contains(lower(evidence_text), {q(x)}) THEN 0.08::double ELSE 0 END" for x in r.get("keywords", [])]
        total = "(" + " + ".join(terms) + ")"
        if needs and name == "Line of Fire":
            total = f"(CASE WHEN list_contains(e, 'Line-of-fire exposure') THEN {total} ELSE {total} * 0.25 END)"
        parts.append(f"SELECT report_id, {q(name)} AS rule, {k} AS k, round({total}, 9) AS raw FROM prep")
    return f"""lab0 AS ({' UNION ALL '.join(parts)}),
lab AS (SELECT report_id, rule, round(least(1.0::double, raw), 3) AS score, row_number() OVER (PARTITION BY report_id ORDER BY least(1.0::double, raw) DESC, k) AS place FROM lab0 WHERE raw >= 0.35),
labs AS (SELECT report_id, string_agg(rule, '; ' ORDER BY place) AS s FROM lab WHERE place <= 3 GROUP BY report_id)"""


def any_of(items: str, wanted) -> str:
    return f"list_has_any({items}, {qlist(wanted)})"


def cue(words, text="low") -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def signal_cte() -> str:
    has = lambda l, v: f"list_contains({l}, {q(v)})"
    s = {
        "electrical": has("h", "Electrical energy"), "chemical": has("h", "Chemical energy / hazardous substance"),
        "thermal": has("h", "Thermal energy"), "vehicle": has("h", "Vehicle / mobile equipment energy"),
        "fall_height": has("h", "Fall-from-height energy"),
        "caught_between": f"({has('h', 'Caught-between / pinch energy')} OR {has('e', 'Caught-between / pinch exposure')})",
        "projectile": f"({has('h', 'Falling object / dropped object energy')} OR {has('e', 'Line-of-fire exposure')})",
        "mechanical": has("h", "Mechanical / moving equipment energy"), "actual_severe": any_of("a", rule_bank.SEVERE_ACTUAL),
        "potential_severe": "len(pt) > 0", "direct_exposure": "len(e) > 0", "line_of_fire": has("e", "Line-of-fire exposure"),
        "work_at_height": has("ac_", "Working at height"), "barrier_failure": "contains(observed_barriers, '[failed_or_absent]')",
        **{k: cue(v) for k, v in rs.CUES.items()},
    }
    cols = ", ".join(f"{v} AS {k}" for k, v in s.items())
    return f"sg AS (SELECT *, {cols} FROM (SELECT *, lower(evidence_text) AS low FROM prep))"


MILD = "(len(a) > 0 AND len(list_filter(a, lambda x: NOT list_contains(" + qlist(rule_bank.MILD_ACTUAL) + ", x))) = 0)"


def w(cond: str, value: float) -> str:
    return f"(CASE WHEN {cond} THEN {value}::double ELSE 0::double END)"


def reasons(pairs) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for c, r in pairs) + "], lambda x: x IS NOT NULL), '; ')"


def reasoning_v01_sql() -> str:
    en, sv = any_of("h", rule_bank.HIGH_ENERGY), any_of("a", rule_bank.SEVERE_ACTUAL)
    mild = f"({MILD} AND NOT {en} AND len(pt) = 0)"
    total = " + ".join([w(en, 0.25), w("len(e) > 0", 0.2), w(sv, 0.35), w("len(pt) > 0", 0.25), w("barriers_failed <> ''", 0.15), w(mild, -0.2)])
    rsn = reasons([(en, "high-energy hazard"), ("len(e) > 0", "human exposure signal"), (sv, "severe/critical actual consequence"), ("len(pt) > 0", "credible severe potential pathway"), ("barriers_failed <> ''", "barrier gap/failure signal"), (mild, "low-energy-only observed event")])
    return with_(PREPARED, label_rules(rule_bank.LABELS_V01, False), f"sc AS (SELECT *, round(greatest(0::double, least(1::double, {total})), 9) AS score, {rsn} AS reason_codes FROM prep)") + f"""SELECT sc.report_id,
  CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS sif_precursor_band, round(score, 3) AS sif_precursor_score,
  CASE WHEN len(pt) > 0 THEN array_to_string(list_slice(pt, 1, 2), ' + ') WHEN {en} THEN 'High-energy hazard with exposure' WHEN len(a) > 0 THEN a[1] ELSE 'No strong SIF precursor signal' END AS primary_trigger,
  reason_codes, barriers_present, barriers_failed, coalesce(labs.s, '') AS lsr_candidates FROM sc LEFT JOIN labs USING (report_id)"""


def reasoning_v02_ctes() -> str:
    gate = f"""CASE WHEN NOT potential_severe THEN false WHEN electrical THEN direct_exposure WHEN caught_between THEN true
  WHEN fall_height THEN medium_fall AND direct_exposure WHEN vehicle THEN strong_vehicle_event AND direct_exposure
  WHEN chemical THEN chemical_face_eye AND (chemical_concentration_evidence OR line_of_fire) WHEN thermal OR projectile THEN direct_exposure
  WHEN mechanical THEN {cue(rs.ENTANGLED, "lower(hazard_evidence || ' ' || exposure_evidence)")} AND direct_exposure ELSE false END"""
    spec = "(caught_between OR line_of_fire OR electrical OR vehicle)"
    en = any_of("h", rule_bank.HIGH_ENERGY_V02)
    gen = f"(NOT {spec} AND len(e) > 0)"
    shield = "(barriers_present <> '' AND NOT actual_severe)"
    lowf = "(low_fall_06m AND NOT actual_severe)"
    mild = f"({MILD} AND NOT actual_severe AND NOT opened)"
    total = " + ".join([w(en, 0.2), w(spec, 0.2), w(gen, 0.06), w("actual_severe", 0.35), w("opened", 0.25), w("barriers_failed <> ''", 0.1), w(shield, -0.03)])
    rsn = reasons([(en, "high-energy mechanism"), (spec, "specific exposure pathway"), (gen, "generic exposure signal"), ("actual_severe", "severe actual consequence"), ("opened", "credible severe potential pathway"), ("NOT opened AND potential_severe", "potential severity signal not sufficiently grounded"), ("barriers_failed <> ''", "explicit barrier failure/absence"), (shield, "protective control explicitly present"), (lowf, "0.6 m fall is low-energy without secondary severe mechanism"), (mild, "observed outcome is low severity without credible escalation gate")])
    return ",\n".join([PREPARED, signal_cte(), f"gated AS (SELECT *, {gate} AS opened FROM sg)", label_rules(rule_bank.LABELS_V02, True),
        f"tot AS (SELECT *, {total} AS total, {lowf} OR {mild} AS capped, {rsn} AS reason_codes FROM gated)",
        """scored AS (SELECT tot.report_id, round(greatest(0::double, least(1::double, CASE WHEN capped THEN least(total, 0.3::double) ELSE total END)), 9) AS score,
  actual_severe AND (electrical OR caught_between OR fall_height OR vehicle) AS forced, opened, potential_severe, pt, a, h, reason_codes, barriers_present, barriers_failed, coalesce(labs.s, '') AS lsr_candidates FROM tot LEFT JOIN labs USING (report_id))""",
        """reasoned AS (SELECT report_id, CASE WHEN forced OR score >= 0.6 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS sif_precursor_band,
  round(score, 3) AS sif_precursor_score, coalesce(CASE WHEN opened THEN pt[1] END, a[1], h[1], 'No strong SIF precursor signal') AS primary_trigger, reason_codes,
  CASE WHEN opened THEN 'potential severity gate passed' WHEN potential_severe THEN 'potential severity gate failed' ELSE '' END AS gate_codes, barriers_present, barriers_failed, lsr_candidates FROM scored)"""])


def _label_sql(rules, needs):
    return with_(PREPARED, label_rules(rules, needs)) + "SELECT report_id, place::int AS place, rule, score FROM lab WHERE place <= 3"


def oracles() -> dict[str, str]:
    from hazardloom.plans.extraction_queries import BURN

    simple = lambda name, bank, cap: with_(REPORTS, BASE, hits(name, bank, cap))
    act = with_(REPORTS, "base AS (SELECT report_id, description AS tx FROM reports)", hits("ac", v04.ACTIVITIES, 5))
    cover = " UNION ALL ".join(
        f"SELECT {q(m)} AS family, round(100.0 * avg(({m} <> '')::int), 2) AS coverage_percent, round(avg({o}_count), 3) AS mean_count FROM fl"
        for m, o in [("hazards", "hazard"), ("exposures", "exposure"), ("consequences", "consequence"), ("barriers", "barrier"), ("activities", "activity")]
    )
    return {
        "extract_v04": extract_v04_sql(),
        "derived_signals": with_(v04_ctes()) + f"SELECT report_id, {SIG_COLS} FROM sig",
        "extract_v05": with_(v05_ctes()) + "SELECT * FROM flat",
        "extract_v06": with_(V06) + "SELECT * FROM flat",
        "activity_metadata": act + """SELECT r.report_id, coalesce(l.s, '') AS activities, coalesce(e.s, '') AS activity_evidence, coalesce(n.n, 0)::int AS activity_count FROM reports r
  LEFT JOIN (SELECT report_id, string_agg(label, '; ' ORDER BY rn) AS s FROM (SELECT report_id, label, min(rn) AS rn FROM ac GROUP BY 1, 2) GROUP BY 1) l USING (report_id)
  LEFT JOIN (SELECT report_id, string_agg(ev, '; ' ORDER BY rn) AS s FROM (SELECT report_id, ev, min(rn) AS rn FROM ac GROUP BY 1, 2) GROUP BY 1) e USING (report_id)
  LEFT JOIN (SELECT report_id, count(*) AS n FROM ac GROUP BY 1) n USING (report_id)""",
        "collect_hits": simple("hz", v04.HAZARDS, 8) + "SELECT report_id, (rn - 1)::int AS position, label, ev AS evidence FROM hz",
        "dedup_longest_evidence": with_(REPORTS, BASE, hits("hz", v06.HAZARDS, 20), longest("hz")) + "SELECT report_id, label, ev AS evidence FROM hz_best",
        "barrier_negation": with_(REPORTS, BASE, barriers_v04()) + "SELECT report_id, label, status, ev AS evidence FROM bar",
        "context_guard": with_(REPORTS, BASE, hits("b", [("Burn", BURN)], 10)) + f"""SELECT report_id, 'Burn' AS label, ev AS evidence FROM (
  SELECT b.report_id, b.ev, x.lw, length(regexp_extract(x.lw, '^(.*?)\\b' || lower(b.ev) || '\\b', 1)) + 1 AS pos_ FROM b JOIN base x USING (report_id))
  WHERE regexp_matches(substr(lw, greatest(pos_ - 40, 1), pos_ - greatest(pos_ - 40, 1) + length(ev) + 40), 'steam|hot|severe')""",
        "potential_consequences": with_(REPORTS, BASE, potentials()) + "SELECT report_id, label, ev AS evidence FROM pot",
        "lsr_labels_v01": _label_sql(rule_bank.LABELS_V01, False),
        "lsr_labels_v02": _label_sql(rule_bank.LABELS_V02, True),
        "reasoning_v01": reasoning_v01_sql(),
        "reasoning_v02": with_(reasoning_v02_ctes()) + "SELECT * FROM reasoned",
        "mechanism_signals": with_(PREPARED, signal_cte()) + "SELECT report_id, " + ", ".join(f"({c})::int AS {c}" for c in rs.SIGNAL_NAMES) + " FROM sg",
        "barrier_status_parse": with_(PREPARED) + "SELECT report_id, barriers_present, barriers_failed FROM prep",
        "reasoning_summary": with_(reasoning_v02_ctes()) + """SELECT sif_precursor_band, count(*)::bigint AS reports, round(avg(sif_precursor_score), 9) AS mean_score,
  sum(CASE WHEN lsr_candidates = '' THEN 0 ELSE len(string_split(lsr_candidates, '; ')) END)::bigint AS rule_candidates FROM reasoned GROUP BY 1""",
        "extraction_coverage": "WITH fl AS (" + extract_v04_sql() + ") " + cover,
    }
