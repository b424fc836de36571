"""Sentence, feature, selection and evaluation oracles."""

from __future__ import annotations

from math import exp, factorial

from hazardloom.banks import audits, precursors
from hazardloom.functions.text import LEVELS
from hazardloom.operators import evaluation as ev
from hazardloom.operators import selection as se
from hazardloom.operators import spans as sp
from hazardloom.operators import triage
from hazardloom.plans import evaluation_queries as eq
from hazardloom.plans import tables as tb
from oracles.analytics import DOMAIN, DONE, GOLD
from oracles.base import ADJUDICATIONS, ANNOTATIONS, MATCH, NORM, REPORTS, SQUEEZE, joined, present, q, qlist, r9, with_
from oracles.evidence import PREDICTIONS, candidates_cte
from oracles.extraction import reasoning_v02_ctes
from hazardloom.banks import rules as rule_bank

SENTENCES = f"""sents AS (SELECT report_id, (i - 1)::int AS sentence_index, s AS sentence, lower(s) AS t FROM (
  SELECT report_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT report_id, list_filter(list_transform(
    string_split(regexp_replace({SQUEEZE}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' -•' || chr(9))), lambda x: x <> '') AS l FROM reports)))"""
RAW_SENTENCES = """rsents AS (SELECT report_id, lower(unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(description, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
  lambda x: trim(x, ' -•' || chr(9))), lambda x: x <> ''))) AS t FROM reports)"""


def spans_cte() -> str:
    parts = []
    for kind, bank in precursors.SPANS.items():
        for name, pats in bank.items():
            terms = "list_sort(list_distinct(list_filter([" + ", ".join(f"regexp_extract(t, {q(p)})" for p in pats) + "], lambda x: x <> '')))"
            parts.append(f"SELECT report_id, {q(kind)} AS evidence_type, sentence_index, {q(name)} AS name, sentence, array_to_string({terms}, ' | ') AS matched_terms FROM sents WHERE {present(pats)}")
    return "spans AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


SPANS = ",\n".join([REPORTS, SENTENCES, spans_cte()])
PIVOT = "pivoted AS (SELECT report_id, " + ", ".join(f"count(*) FILTER (evidence_type = {q(k)})::bigint AS {k}" for k in precursors.SPANS) + " FROM spans GROUP BY report_id)"


def mentions_cte() -> str:
    def agg(bank):
        cases = ", ".join(f"CASE WHEN bool_or({present(p)}) THEN {q(c)} END" for c, p in sorted(bank.items()))
        return f"list_filter([{cases}], lambda x: x IS NOT NULL)"

    return f"mentions AS MATERIALIZED (SELECT r.report_id, coalesce(c, []) AS c, coalesce(g, []) AS g FROM reports r LEFT JOIN (SELECT report_id, {agg(audits.CONTROLS)} AS c, {agg(audits.GAPS)} AS g FROM rsents GROUP BY report_id) USING (report_id))"


MENTIONS = ",\n".join([RAW_SENTENCES, mentions_cte()])

AUDITED = ",\n".join(
    [
        PREDICTIONS, GOLD, SENTENCES, spans_cte(), PIVOT, MENTIONS, candidates_cte(rule_bank.CURRENT, "predictions"),
        """audited AS (SELECT g.report_id, g.p, g.truth, coalesce(precursor, 0) AS precursor, coalesce(barrier, 0) AS barrier, coalesce(lsr, 0) AS lsr, len(m.c) AS controls, len(m.g) AS gaps,
  coalesce(k.n, 0) AS cand FROM gold g JOIN mentions m USING (report_id) LEFT JOIN pivoted USING (report_id) LEFT JOIN (SELECT report_id, count(*) AS n FROM candidates GROUP BY 1) k USING (report_id))""",
    ]
)
FLAGS = {
    "flag_high_score_no_precursor": "p >= 0.5 AND precursor = 0", "flag_lsr_without_lsr_evidence": "cand > 0 AND lsr = 0",
    "flag_barrier_without_barrier_evidence": "gaps > 0 AND barrier = 0", "flag_high_score_label_no": "p >= 0.5 AND truth = 0",
    "flag_low_score_label_yes": "p < 0.5 AND truth = 1",
}
REVIEW_SCORE = r9("p + 0.02::double * precursor + 0.02::double * barrier + 0.01::double * lsr")
REVIEW_TYPE = "CASE WHEN p >= 0.8 AND precursor = 0 THEN 'HIGH_SCORE_NO_PRECURSOR_EVIDENCE' WHEN p < 0.5 AND truth = 1 THEN 'LOW_SCORE_FALSE_NEGATIVE' WHEN p >= 0.8 AND truth = 0 THEN 'HIGH_SCORE_FALSE_POSITIVE' ELSE 'NORMAL' END"


def inspection() -> str:
    fams = {"hazard": audits.HAZARDS, "exposure": audits.EXPOSURES, "pathway": audits.PATHWAYS, "control": audits.INSPECTION_CONTROLS}
    cols = []
    for k, bank in fams.items():
        names = "list_filter([" + ", ".join(f"CASE WHEN {present(p, 'lw')} THEN {q(c)} END" for c, p in sorted(bank.items())) + "], lambda x: x IS NOT NULL)"
        pats = [p for c in bank.values() for p in c]
        terms = "list_sort(list_distinct(list_filter([" + ", ".join(f"regexp_extract(tx, {q('(?i)' + p)})" for p in pats) + "], lambda x: x <> '')))"
        cols.append(f"{names} AS {k}_l, {joined(terms)} AS {k}_terms")
    neg = "list_sort(list_distinct(list_filter([" + ", ".join(f"regexp_extract(tx, {q('(?i)' + p)})" for p in audits.NEGATIONS) + "], lambda x: x <> '')))"
    words = list(reversed(list(sp.RECOMMENDATIONS)))
    return f"""insp0 AS (SELECT b.report_id, {', '.join(cols)}, {joined(neg)} AS negation_or_gap_signals, coalesce(n.n, 0)::int AS sentence_count FROM (SELECT report_id, {SQUEEZE} AS tx, lower({SQUEEZE}) AS lw FROM reports) b
  LEFT JOIN (SELECT report_id, count(*) AS n FROM sents GROUP BY 1) n USING (report_id)),
insp AS (SELECT *, (len(hazard_l) > 0)::int + (len(exposure_l) > 0)::int + (len(pathway_l) > 0)::int AS pathway_strength FROM insp0),
inspected AS MATERIALIZED (SELECT report_id, {', '.join(joined(k + '_l') + f' AS {k}_categories, {k}_terms' for k in fams)}, negation_or_gap_signals, sentence_count, pathway_strength,
  {qlist(words)}[pathway_strength + 1] AS pathway_assessment, {qlist([sp.RECOMMENDATIONS[w] for w in words])}[pathway_strength + 1] AS review_recommendation FROM insp)"""


def features_cte() -> str:
    cols = [f"{present(p)}::int AS {pre}{k}" for pre, bank in precursors.FEATURES.items() for k, p in bank.items()]
    cols += [f"regexp_matches(t, {q(chr(92) + 'b' + b + chr(92) + 'b')})::int AS body_{b}_mentioned" for b in precursors.BODY_PARTS]
    big = lambda p: f"list_max(list_transform(regexp_extract_all(t, {q(p)}, 1), lambda x: try_cast(replace(x, ',', '.') AS double)))"
    cols += ["length(t)::int AS narrative_chars", "len(regexp_extract_all(t, '\\b\\w+\\b'))::int AS narrative_words", f"{big(precursors.HEIGHT)} AS max_height_m", f"{big(precursors.VOLTAGE)} AS max_voltage_v"]
    ix = ", ".join(f"({a} + {b} = 2)::int AS {k}" for k, (a, b) in precursors.INTERACTIONS.items())
    return f"""ft0 AS (SELECT report_id, {', '.join(cols)} FROM (SELECT report_id, {NORM} AS t FROM reports)),
ft AS MATERIALIZED (SELECT *, (coalesce(max_height_m, 0) >= 2)::int AS significant_height_signal, (coalesce(max_height_m, 9) < 1)::int AS low_height_signal, (coalesce(max_voltage_v, 0) >= 50)::int AS high_voltage_signal, {ix} FROM ft0)"""


LABELLED = "labelled AS (SELECT *, (label = 'YES')::int AS truth FROM reports WHERE label IS NOT NULL)"


CUMULATIVE = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12)]


def hn(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


RATES = """tp + fp + fn + tn AS n, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn)::double END, 9) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::double END, 9) AS "precision",
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::double END, 9) AS recall, round(CASE WHEN 5 * tp + 4 * fn + fp = 0 THEN 0 ELSE 5 * tp / (5 * tp + 4 * fn + fp)::double END, 9) AS f2"""


def conf(pred: str, truth: str = "truth") -> str:
    return f"(count(*) FILTER ({pred} AND {truth} = 1))::bigint AS tp, (count(*) FILTER ({pred} AND {truth} = 0))::bigint AS fp, (count(*) FILTER (NOT ({pred}) AND {truth} = 1))::bigint AS fn, (count(*) FILTER (NOT ({pred}) AND {truth} = 0))::bigint AS tn"


def grid_ctes(grid) -> str:
    return f"grid AS (SELECT unnest({qlist(grid)})::double AS threshold), gc AS (SELECT threshold, {conf('p >= threshold')} FROM labelled, grid GROUP BY threshold), gm AS (SELECT *, {RATES} FROM gc)"


FOLDED = f"folded AS (SELECT report_id, truth, repeat, (row_number() OVER (ORDER BY repeat, truth, h, report_id) % {eq.FOLDS})::int AS fold FROM (SELECT report_id, truth, repeat::int AS repeat, {hn('repeat', 'report_id')} AS h FROM labelled, range(1, {eq.REPEATS + 1}) x(repeat)))"
GROUPED = f"grouped AS (SELECT report_id, label, truth, 'derived_' || substr(sha256({MATCH}), 1, 16) AS duplicate_group_id FROM labelled)"
SPLIT = f"""grp AS (SELECT duplicate_group_id, CASE WHEN min(label) = max(label) THEN min(label) ELSE 'MIXED' END AS stratum FROM grouped GROUP BY 1),
place AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {hn(q('split'), 'duplicate_group_id')}, duplicate_group_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM grp),
split AS MATERIALIZED (SELECT g.report_id, g.label, g.truth, g.duplicate_group_id, stratum, CASE WHEN k / n::double < 0.7 THEN 'train' WHEN k / n::double < 0.85 THEN 'validation' ELSE 'test' END AS split FROM grouped g JOIN place USING (duplicate_group_id))"""
NAIVE = f"naive AS (SELECT *, CASE WHEN {hn(q('naive'), 'report_id')} % 20 < 14 THEN 'train' WHEN {hn(q('naive'), 'report_id')} % 20 < 17 THEN 'validation' ELSE 'test' END AS split FROM grouped)"
FSCORES = """fscores AS MATERIALIZED (SELECT f.report_id, f.truth, repeat, fold, 'first' AS model, (p * repeat + p2) / (repeat + 1) AS score FROM folded f JOIN labelled l USING (report_id)
  UNION ALL SELECT f.report_id, f.truth, repeat, fold, 'second', p2 FROM folded f JOIN labelled l USING (report_id)),
fm AS MATERIALIZED (SELECT *, """ + RATES + f""" FROM (SELECT model, repeat, fold, {conf('score >= 0.5')} FROM fscores GROUP BY 1, 2, 3))"""
SUMMARY = "summ AS (" + " UNION ALL ".join(f"SELECT model, {q(m)} AS metric, {r9('avg(' + chr(34) + m + chr(34) + ')')} AS mean, {r9('stddev_samp(' + chr(34) + m + chr(34) + ')')} AS std, min(\"{m}\") AS min, max(\"{m}\") AS max FROM fm GROUP BY model" for m in eq.METRICS) + ")"
SCORED = f"""al0 AS (SELECT report_id, p, p2, risk, 0.5::double * p + 0.5::double * p2 AS hybrid_probability, abs(p - p2) AS model_disagreement FROM reports),
al1 AS (SELECT *, greatest(0::double, least(1::double, 1::double - 2::double * abs(hybrid_probability - 0.5::double))) AS boundary_uncertainty FROM al0),
al2 AS (SELECT *, (model_disagreement - min(model_disagreement) OVER ()) / (max(model_disagreement) OVER () - min(model_disagreement) OVER ()) AS sd, (boundary_uncertainty - min(boundary_uncertainty) OVER ()) / (max(boundary_uncertainty) OVER () - min(boundary_uncertainty) OVER ()) AS su FROM al1),
scored AS (SELECT report_id, p, p2, risk, hybrid_probability, model_disagreement, boundary_uncertainty, round(0.45::double * sd + 0.35::double * su + 0.2::double * sd, 9) AS ranking_score,
  CASE WHEN p >= 0.5 AND p2 < 0.5 THEN 'TF-IDF YES / Transformer NO disagreement' WHEN p < 0.5 AND p2 >= 0.5 THEN 'TF-IDF NO / Transformer YES disagreement' WHEN abs(hybrid_probability - 0.5) <= 0.08 THEN 'Near decision boundary'
  WHEN model_disagreement >= 0.2 THEN 'Strong model disagreement' ELSE 'High combined uncertainty' END AS selection_reason FROM al2)"""
LEVEL = "list_position(" + qlist(LEVELS) + ", {})"
UNUSED = "unused AS (SELECT *, length(description) AS chars FROM reports WHERE report_id NOT IN (SELECT report_id FROM adjudications))"


def boundary() -> str:
    whens, names = [], []
    for i, (rule, wanted, pattern) in enumerate(se.BOUNDARY_RULES, start=1):
        cond = " AND ".join([*([f"upper(trim(sif_potential)) = {q(wanted)}"] if wanted else []), *([f"regexp_matches(tx, {q(pattern)})"] if pattern else [])])
        whens.append(f"WHEN {cond} THEN {i}")
        names.append(f"WHEN {cond} THEN {q(rule)}")
    text = f"{NORM} || ' ' || trim(lower(sif_reason))"
    return with_(REPORTS, ANNOTATIONS, DONE) + f"SELECT report_id, CASE {' '.join(whens)} ELSE 7 END AS rule_order, CASE {' '.join(names)} ELSE 'manual_fill' END AS boundary_selection_rule FROM (SELECT *, {text} AS tx FROM done) ORDER BY 2, 1 LIMIT 10"


def greedy_split() -> str:
    """The greedy rule a group at a time; ties go to test, then validation."""
    shares = {"test": 0.15, "validation": 0.15, "train": 0.70}
    error = lambda s: " + ".join(f"{w}::double * (abs({s}_{k} + g.{k} - t_{k} * {share}::double) / greatest(t_{k} * {share}::double, 1.0::double))" for w, k in ((0.55, "n"), (0.25, "yes"), (0.2, "no")) for share in (shares[s],))
    grown = ", ".join(f"CASE WHEN pick = '{s}' THEN {s}_{k} + {k} ELSE {s}_{k} END AS {s}_{k}" for s in shares for k in ("n", "yes", "no"))
    state = ", ".join(f"{s}_{k}" for s in shares for k in ("n", "yes", "no"))
    zero = ", ".join(f"0::bigint AS {s}_{k}" for s in shares for k in ("n", "yes", "no"))
    return "WITH RECURSIVE " + with_(REPORTS, LABELLED, GROUPED, f"""gg AS (SELECT duplicate_group_id, count(*) AS n, count(*) FILTER (label = 'YES') AS yes, count(*) FILTER (label = 'NO') AS no FROM grouped GROUP BY 1),
go AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, abs(yes - no) DESC, yes DESC, {hn(q('split'), 'duplicate_group_id')}, duplicate_group_id) AS k FROM gg),
tt AS (SELECT sum(n)::double AS t_n, sum(yes)::double AS t_yes, sum(no)::double AS t_no FROM gg),
walk AS (SELECT 0::bigint AS k, NULL::varchar AS duplicate_group_id, NULL::varchar AS pick, {zero}
  UNION ALL SELECT k, duplicate_group_id, pick, {grown} FROM (
    SELECT g.k, g.duplicate_group_id, g.n, g.yes, g.no, {state}, CASE WHEN e1 <= e2 AND e1 <= e3 THEN 'test' WHEN e2 <= e3 THEN 'validation' ELSE 'train' END AS pick FROM (
      SELECT g.*, {", ".join("w." + c for c in state.split(", "))}, {error('test')} AS e1, {error('validation')} AS e2, {error('train')} AS e3 FROM walk w JOIN go g ON g.k = w.k + 1, tt) g))""").removeprefix("WITH ") + "SELECT g.report_id, g.label, g.truth, g.duplicate_group_id, pick AS split FROM grouped g JOIN walk USING (duplicate_group_id)"


def oracles() -> dict[str, str]:
    ft_names = sp.precursor_feature_names()
    base = with_(REPORTS, LABELLED)
    best = lambda grid: with_(REPORTS, LABELLED, grid_ctes(grid)) + """SELECT * FROM gm ORDER BY ("precision" >= 0.5) DESC, f2 DESC, recall DESC, "precision" DESC, threshold LIMIT 1"""
    summ = with_(REPORTS, LABELLED, FOLDED, FSCORES, SUMMARY)
    numeric = "num AS (SELECT report_id, " + ", ".join(f"{c}::double AS {c}" for c in ft_names) + " FROM ft)"
    vocab = f"""wd AS (SELECT doc_id, regexp_extract_all(translate(lower(text), {q(tb.ACCENTED.lower())}, {q(tb.PLAIN.lower())}), '\\b\\w\\w+\\b') AS w FROM documents),
un AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM wd), gr AS (SELECT doc_id, term FROM un UNION ALL SELECT a.doc_id, a.term || ' ' || b.term FROM un a JOIN un b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
ct AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY 1, 2), vc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM ct GROUP BY 1 HAVING count(*) <= 0.98 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 10000),
rw AS (SELECT doc_id, ct.term, (ln(tf) + 1) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::double) + 1) AS raw FROM ct JOIN vc USING (term))"""
    gold_rank = """gs AS (SELECT report_id, department, risk, actual_level, length(description) AS chars, CASE WHEN potential_level IN ('I', 'II') THEN 'lower' WHEN potential_level = 'III' THEN 'medium' WHEN potential_level = 'IV' THEN 'medium_high' ELSE 'high' END AS band FROM reports),
gf AS (SELECT *, count(*) OVER (PARTITION BY band, department) AS df, count(*) OVER (PARTITION BY band, department, risk) AS cf FROM gs),
go AS (SELECT *, row_number() OVER (PARTITION BY band, department ORDER BY df, cf, """ + LEVEL.format("actual_level") + """ DESC, chars, report_id) AS rd FROM gf),
gp AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY rd > 1, df, cf, """ + LEVEL.format("actual_level") + """ DESC, chars, report_id)::int AS place FROM go)"""
    cal3 = """c0 AS (SELECT report_id, department, risk, chars, CASE WHEN potential_level IN ('I', 'II') THEN 'lower' WHEN potential_level = 'III' THEN 'medium' WHEN potential_level = 'IV' THEN 'high' ELSE 'very_high' END AS stratum FROM unused),
c1 AS (SELECT *, row_number() OVER (PARTITION BY stratum, department ORDER BY department, risk, chars, report_id) = 1 AS a FROM c0),
c2 AS (SELECT *, NOT a AND row_number() OVER (PARTITION BY stratum, risk, a ORDER BY department, risk, chars, report_id) = 1 AS b FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END, department, risk, chars, report_id) AS rn FROM c2)"""
    boot = f"""bt AS (SELECT rep, p, truth, list_sum(list_transform({qlist(CUMULATIVE)}, lambda c: (c <= u)::int)) AS w FROM (SELECT rep, p, truth, ('0x' || substr(md5(concat_ws('|', (rep - 1) // 4, report_id)), ((rep - 1) % 4) * 8 + 1, 8))::bigint / 4294967296.0::double AS u FROM labelled, range(1, 5001) r(rep))),
bc AS (SELECT rep, sum(w) FILTER (p >= 0.5 AND truth = 1) AS tp, sum(w) FILTER (p >= 0.5 AND truth = 0) AS fp, sum(w) FILTER (p < 0.5 AND truth = 1) AS fn, sum(w) FILTER (p < 0.5 AND truth = 0) AS tn FROM bt GROUP BY rep),
bm AS (SELECT rep, {RATES} FROM bc), bh AS (SELECT rep, p, sum(w * truth) AS pos, sum(w) AS al FROM bt GROUP BY 1, 2),
bw AS (SELECT rep, pos, sum(pos) OVER s AS cp, sum(al) OVER s AS ca FROM bh WINDOW s AS (PARTITION BY rep ORDER BY p DESC)),
bp AS (SELECT rep, round(sum(CASE WHEN ca > 0 THEN pos * cp / ca ELSE 0 END) / sum(pos), 9) AS pr_auc FROM bw GROUP BY rep),
bl AS (SELECT 'accuracy' AS metric, accuracy AS v FROM bm UNION ALL SELECT 'precision', "precision" FROM bm UNION ALL SELECT 'recall', recall FROM bm UNION ALL SELECT 'f2', f2 FROM bm UNION ALL SELECT 'pr_auc', pr_auc FROM bp)"""
    return {
        "evidence_spans": with_(SPANS) + "SELECT * FROM spans",
        "evidence_pivot": with_(SPANS, PIVOT) + "SELECT * FROM pivoted",
        "top_mechanisms": with_(SPANS) + """SELECT report_id, string_agg(name, '; ' ORDER BY n DESC, name) AS top_mechanisms FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, name) AS rn FROM (
  SELECT report_id, name, count(*) AS n FROM spans WHERE evidence_type = 'precursor' GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY report_id""",
        "barrier_audit": with_(REPORTS, MENTIONS) + f"SELECT report_id, {joined('c')} AS control_categories_mentioned, {joined('g')} AS barrier_gap_categories_mentioned, len(c)::int AS control_category_count, len(g)::int AS barrier_gap_category_count FROM mentions",
        "barrier_mentions": with_(REPORTS, MENTIONS) + f"""SELECT count(*)::bigint AS records, {r9('avg((len(c) > 0)::int)')} AS control_mentioned_rate, {r9('avg((len(g) > 0)::int)')} AS gap_mentioned_rate, {r9('avg((len(c) > 0 AND len(g) > 0)::int)')} AS both_rate,
  {r9('avg((len(c) = 0 AND len(g) = 0)::int)')} AS neither_rate, count(*) FILTER (len(c) > 0 AND len(g) = 0)::bigint AS control_only_count, count(*) FILTER (len(c) = 0 AND len(g) > 0)::bigint AS gap_only_count,
  count(*) FILTER (len(c) > 0 AND len(g) > 0)::bigint AS both_count, count(*) FILTER (len(c) = 0 AND len(g) = 0)::bigint AS neither_count FROM mentions""",
        "pathway_inspection": with_(REPORTS, SENTENCES, inspection()) + "SELECT * FROM inspected",
        "features_v02": with_(REPORTS, features_cte()) + f"SELECT report_id, {', '.join(ft_names)} FROM ft",
        "ranking_audit": with_(AUDITED) + f"SELECT report_id, p, precursor, barrier, lsr, precursor = 0 AS flag_no_precursor_evidence, {', '.join(f'{c} AS {k}' for k, c in FLAGS.items())}, {REVIEW_SCORE} AS review_score FROM audited",
        "flagged_cases": with_(AUDITED) + f"SELECT report_id, {REVIEW_SCORE} AS review_score FROM audited WHERE {' OR '.join('(' + c + ')' for c in FLAGS.values())}",
        "triage_v08": with_(AUDITED) + f"""SELECT report_id, CASE WHEN p >= 0.8 AND precursor > 0 THEN 'P1' WHEN p >= 0.8 THEN 'P2' WHEN p >= 0.5 AND precursor > 0 THEN 'P3' ELSE 'P4' END AS triage_tier,
  CASE WHEN p >= 0.8 AND precursor > 0 THEN 'high_model_score_with_narrative_precursor_evidence' WHEN p >= 0.8 THEN 'high_model_score_but_no_precursor_evidence_mandatory_review' WHEN p >= 0.5 AND precursor > 0 THEN 'moderate_model_score_with_narrative_precursor_evidence' ELSE 'low_or_weak_model_score' END AS triage_reason,
  precursor = 0 AS flag_no_precursor_evidence, controls = 0 AS flag_no_control_evidence, gaps = 0 AS flag_no_gap_evidence, cand = 0 AS flag_no_rule_evidence, (p >= 0.8 AND truth = 0) OR (p < 0.3 AND truth = 1) AS flag_model_label_conflict,
  CASE WHEN p >= 0.8 AND precursor = 0 THEN {q(triage.MANDATORY)} ELSE {q(triage.INSTRUCTION)} END AS review_instruction FROM audited""",
        "conflict_review": with_(AUDITED, f"cr AS (SELECT report_id, p, {REVIEW_TYPE} AS review_type FROM audited)", "cq(review_type, review_rank, review_questions) AS (VALUES " + ", ".join(f"({q(k)}, {n}, {q(t)})" for k, (n, t) in triage.CONFLICT_QUESTIONS.items()) + ")") + "SELECT report_id, p, review_rank, review_type, review_questions, '' AS human_notes FROM cr JOIN cq USING (review_type)",
        "conflict_summary": with_(AUDITED, inspection()) + f"SELECT {REVIEW_TYPE} AS review_type, i.pathway_assessment AS inspection, count(*)::bigint AS cases, {r9('avg((i.pathway_strength = 3)::int)')} AS full_pathway_rate FROM audited JOIN inspected i USING (report_id) GROUP BY 1, 2",
        "error_types": with_(PREDICTIONS, GOLD) + "SELECT report_id, CASE WHEN (p >= 0.5)::int = truth THEN 'CORRECT' WHEN p >= 0.5 THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS error_type FROM gold",
        "queue_enrichment": with_(PREDICTIONS, GOLD) + f"""SELECT 'P1-' || d.review_priority AS queue, count(g.report_id)::bigint AS records, coalesce(sum(truth), 0)::bigint AS yes, {r9('coalesce(sum(truth) / nullif(count(g.report_id), 0)::double, 0)')} AS gold_positive_rate,
  {r9('coalesce(sum(truth), 0) / (SELECT sum(truth) FROM gold)::double')} AS recall FROM {DOMAIN} LEFT JOIN gold g ON g.review_priority <= d.review_priority GROUP BY d.review_priority""",
        "ranking_at_k": base + f"""SELECT k, {r9('avg(truth)')} AS precision_at_k, {r9('sum(truth) / (SELECT sum(truth) FROM labelled)::double')} AS recall_at_k FROM (SELECT truth, row_number() OVER (ORDER BY p DESC, report_id) AS rn FROM labelled) r
  JOIN (SELECT unnest([5, 10, 15, 20]) AS k) ON rn <= k GROUP BY k""",
        "priority_quartiles": with_(REPORTS) + "SELECT report_id, p, place::bigint AS place, greatest(1, ceil(4 * (place - 1) / (n - 1)::double))::int AS tier FROM (SELECT report_id, p, row_number() OVER (ORDER BY p, report_id) AS place, count(*) OVER () AS n FROM reports)",
        "select_gold_set": with_(REPORTS, gold_rank) + "SELECT report_id, band, place FROM gp WHERE place <= CASE WHEN band IN ('high', 'lower') THEN 10 ELSE 15 END",
        "select_calibration_02": with_(REPORTS, ADJUDICATIONS, UNUSED) + """(SELECT report_id, 'low' AS stratum FROM unused WHERE potential_level IN ('I', 'II') ORDER BY chars, department, report_id LIMIT 4) UNION ALL
  (SELECT report_id, 'medium' FROM unused WHERE potential_level = 'III' ORDER BY abs(chars - 350), risk, report_id LIMIT 3) UNION ALL (SELECT report_id, 'high' FROM unused WHERE potential_level IN ('IV', 'V', 'VI') ORDER BY department, risk, chars, report_id LIMIT 3)""",
        "select_calibration_03": with_(REPORTS, ADJUDICATIONS, UNUSED, cal3) + "SELECT report_id, stratum FROM c3 WHERE rn <= 5",
        "select_boundary": boundary(),
        "active_learning_scores": with_(REPORTS, SCORED) + "SELECT * FROM scored",
        "select_active_batch": with_(REPORTS, SCORED, """b1 AS (SELECT *, 1 AS ps, row_number() OVER (ORDER BY model_disagreement DESC, report_id) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY model_disagreement DESC, report_id) AS rr FROM scored) WHERE rr <= 4 ORDER BY model_disagreement DESC, report_id LIMIT 30),
b2 AS (SELECT *, 2 AS ps, row_number() OVER (ORDER BY ranking_score DESC, model_disagreement DESC, boundary_uncertainty DESC, report_id) AS rn FROM scored WHERE report_id NOT IN (SELECT report_id FROM b1))""") + """SELECT report_id, risk, selection_reason, row_number() OVER (ORDER BY ps, rn)::int AS active_learning_rank FROM
  (SELECT report_id, risk, selection_reason, ps, rn FROM b1 UNION ALL SELECT report_id, risk, selection_reason, ps, rn FROM b2) ORDER BY ps, rn LIMIT 30""",
        "binary_metrics": with_(REPORTS, LABELLED) + f"SELECT *, {RATES} FROM (SELECT {conf('p >= 0.5')} FROM labelled)",
        "average_precision": base + f"""SELECT {r9('sum(pos * cp / ca::double) / sum(pos)')} AS average_precision, sum(pos)::bigint AS positives, sum(al)::bigint AS n FROM (SELECT pos, al, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(al) OVER (ORDER BY p DESC) AS ca FROM
  (SELECT p, sum(truth) AS pos, count(*) AS al FROM labelled GROUP BY p))""",
        "threshold_search_oof": with_(REPORTS, LABELLED, f"grid AS (SELECT DISTINCT threshold FROM (SELECT unnest({qlist(eq.OOF_GRID)})::double AS threshold UNION ALL SELECT round(p, 6) FROM labelled)), gc AS (SELECT threshold, {conf('p >= threshold')} FROM labelled, grid GROUP BY threshold), gm AS (SELECT *, {RATES} FROM gc)")
        + 'SELECT threshold, f2, "precision", recall, fp, fn FROM gm ORDER BY f2 DESC, threshold DESC LIMIT 1',
        "threshold_search_floor": best(eq.FLOOR_GRID), "threshold_search_wide": best(eq.WIDE_GRID),
        "threshold_table": with_(REPORTS, LABELLED, grid_ctes(eq.TABLE_GRID)) + "SELECT * FROM gm",
        "stratified_folds": with_(REPORTS, LABELLED, FOLDED) + "SELECT * FROM folded",
        "group_folds": with_(REPORTS, LABELLED, GROUPED, f"gl AS (SELECT duplicate_group_id, (avg(truth) >= 0.5)::int AS mj FROM grouped GROUP BY 1), gd AS (SELECT duplicate_group_id, repeat, (row_number() OVER (ORDER BY repeat, mj, h, duplicate_group_id) % {eq.FOLDS})::int AS fold FROM (SELECT duplicate_group_id, mj, repeat::int AS repeat, {hn('repeat', 'duplicate_group_id')} AS h FROM gl, range(1, {eq.REPEATS + 1}) x(repeat)))")
        + "SELECT report_id, duplicate_group_id, truth, repeat, fold FROM grouped JOIN gd USING (duplicate_group_id)",
        "oof_scores": with_(REPORTS, LABELLED, FOLDED, FSCORES) + f"SELECT report_id, {r9('avg(score)')} AS oof_score, count(*)::bigint AS parts, count(*) = {eq.REPEATS} AS complete FROM fscores WHERE model = 'first' GROUP BY 1",
        "fold_summary": summ + "SELECT * FROM summ",
        "model_deltas": summ + f"SELECT s.model, s.metric, s.mean, {r9('s.mean - b.mean')} AS delta FROM summ s JOIN summ b ON b.metric = s.metric AND b.model = 'first'",
        "bootstrap_ci": with_(REPORTS, LABELLED, boot) + f"SELECT metric, {r9('quantile_cont(v, 0.025)')} AS ci_low, {r9('quantile_cont(v, 0.975)')} AS ci_high, count(*)::bigint AS valid_samples FROM bl GROUP BY 1",
        "group_safe_split": with_(REPORTS, LABELLED, GROUPED, SPLIT) + "SELECT * FROM split",
        "split_profile": with_(REPORTS, LABELLED, GROUPED, SPLIT) + f"""SELECT split, count(*)::bigint AS records, count(*) FILTER (label = 'YES')::bigint AS yes, count(DISTINCT duplicate_group_id)::bigint AS groups, min(report_id) AS first_id, max(report_id) AS last_id,
  {r9("count(*) FILTER (label = 'YES') / count(*)::double")} AS yes_rate, sha256(sum(('0x' || substr(sha256(report_id), 1, 12))::bigint)::varchar) AS signature FROM split GROUP BY split""",
        "split_leakage": with_(REPORTS, LABELLED, GROUPED, NAIVE) + "SELECT 'duplicate_group_id' AS key, duplicate_group_id AS value, count(DISTINCT split)::bigint AS splits FROM naive GROUP BY 2 HAVING count(DISTINCT split) > 1",
        "split_pair_overlap": with_(REPORTS, LABELLED, GROUPED, NAIVE, "ps AS (SELECT DISTINCT duplicate_group_id AS g, split FROM naive)")
        + """SELECT a, b, (SELECT count(*) FROM ps x JOIN ps y USING (g) WHERE x.split = a AND y.split = b)::bigint AS shared FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(a, b)""",
        "greedy_group_split": greedy_split(),
        "split_overlap": with_(REPORTS, LABELLED, GROUPED, NAIVE) + "SELECT splits, count(*)::bigint AS groups FROM (SELECT count(DISTINCT split)::bigint AS splits FROM naive GROUP BY duplicate_group_id) WHERE splits > 1 GROUP BY 1",
        "unsplit_ids": with_(REPORTS) + "SELECT report_id FROM reports WHERE label IS NULL",
        "band_rule_eval": with_(reasoning_v02_ctes(), LABELLED, GROUPED, SPLIT, "br AS (SELECT truth, split, 'HIGH' AS rule, sif_precursor_band = 'HIGH' AS flag FROM split JOIN reasoned USING (report_id) UNION ALL SELECT truth, split, 'HIGH+MEDIUM', sif_precursor_band <> 'LOW' FROM split JOIN reasoned USING (report_id))") + f"SELECT *, {RATES} FROM (SELECT split, rule, {conf('flag')} FROM br GROUP BY 1, 2)",
        "score_consistency": with_(REPORTS) + f"SELECT count(*)::bigint AS records, {r9('avg(abs(p - p2))')} AS mean_abs_diff, {r9('max(abs(p - p2))')} AS max_abs_diff, 'FAIL' AS status FROM reports",
        "c_grid_coverage": with_(REPORTS, LABELLED, GROUPED, SPLIT) + """SELECT c, count(*)::bigint AS scored, sum(truth)::bigint AS positives, 0::bigint AS without_score
  FROM split, (VALUES (0.1::double), (0.25::double), (0.5::double), (1.0::double)) g(c) WHERE split = 'validation' GROUP BY c""",
        "train_all_missing": with_(REPORTS, LABELLED, GROUPED, SPLIT, features_cte(), numeric, "tr AS (SELECT n.* FROM num n JOIN split s USING (report_id) WHERE split = 'train')")
        + " UNION ALL ".join(f"SELECT {q(c)} AS feature, count({c})::bigint AS values, count({c}) = 0 AS dropped FROM tr" for c in ft_names) + " UNION ALL SELECT 'always_missing', 0, true",
        "impute_with_indicator": with_(REPORTS, features_cte(), numeric) + "SELECT report_id, coalesce(max_height_m, (SELECT median(max_height_m) FROM num)) AS max_height_m, coalesce(max_voltage_v, (SELECT median(max_voltage_v) FROM num)) AS max_voltage_v, narrative_words, (max_height_m IS NULL)::int AS max_height_m_missing, (max_voltage_v IS NULL)::int AS max_voltage_v_missing FROM num",
        "standardize": with_(REPORTS, features_cte(), numeric) + "SELECT report_id, round((narrative_words - avg(narrative_words) OVER ()) / stddev_pop(narrative_words) OVER (), 6) AS narrative_words FROM num",
        "feature_manifest": with_(REPORTS, features_cte(), numeric) + " UNION ALL ".join(f"SELECT {q(c)} AS feature, count(*)::bigint AS records, (count(*) - count({c}))::bigint AS missing, count(DISTINCT {c})::bigint AS distinct_values, min({c}) AS low, max({c}) AS high, count(DISTINCT {c}) <= 2 AND min({c}) >= 0 AND max({c}) <= 1 AS is_binary FROM num" for c in ft_names),
        "hybrid_vectors": with_(vocab, "nz AS (SELECT doc_id, count(*) AS n FROM rw WHERE raw <> 0 GROUP BY 1)")
        + "SELECT 'report_' || printf('%06d', d.doc_id) AS report_id, 10000 + 64 + 1 AS width, coalesce(n, 0)::int AS entries, CASE WHEN n > 0 THEN 1.0::double ELSE 0.0::double END AS squared_length FROM documents d LEFT JOIN nz USING (doc_id)",
        "tfidf_weights": with_(vocab) + "SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM rw",
    }
