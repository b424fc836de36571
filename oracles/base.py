"""DuckDB text of the working tables and small generators shared by the oracles."""

from __future__ import annotations

from hazardloom.plans import tables as t


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def h(tag: str, key: str = "doc_id") -> str:
    return f"('0x' || substr(md5('{tag}|' || {key}), 1, 8))::bigint"


REPORTS = f"""reports AS (
  SELECT d.doc_id, 'report_' || printf('%06d', d.doc_id) AS report_id,
    {qlist(t.SETTINGS)}[({h('a', 'd.doc_id')} % 24) + 1] || ' ' || {qlist(t.OUTCOMES)}[({h('b', 'd.doc_id')} % 16) + 1]
      || ' Record batch ' || ({h('c', 'd.doc_id')} % 97) || '. ' || translate(d.text, {q(t.ACCENTED)}, {q(t.PLAIN)}) AS description, d.text AS raw_text,
    d.lang AS department, d.source AS site,
    'local_' || lpad(({h('l', 'd.doc_id')} % 12)::varchar, 2, '0') AS location,
    ['I','II','III','IV','V'][({h('v', 'd.doc_id')} % 5) + 1] AS actual_level,
    ['I','II','III','IV','V','VI'][({h('w', 'd.doc_id')} % 6) + 1] AS potential_level,
    {qlist(t.RISKS)}[({h('r', 'd.doc_id')} % 7) + 1] AS risk,
    CASE WHEN d.doc_id % 50 < 10 THEN {qlist(t.EDGE_SCORES)}[(d.doc_id % 50) + 1]::double
      ELSE ({h('p', 'd.doc_id')} % 10001) / 10000.0::double END AS p,
    ({h('q', 'd.doc_id')} % 10001) / 10000.0::double AS p2,
    '2016-' || lpad((1 + {h('m', 'd.doc_id')} % 13)::varchar, 2, '0') || '-15' AS raw_date,
    CASE WHEN l.quality = 1 THEN 'YES' WHEN l.quality = 0 THEN 'NO' END AS label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

REVIEWS = """reviews AS (
    SELECT event_id AS id, 'report_' || printf('%06d', (event_id % (SELECT count(*) FROM documents))) AS report_id,
      CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'NEEDS_MORE_INFO' ELSE upper(event_type) END AS decision,
      'user_' || user_id AS reviewer, props AS note, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at
    FROM events)"""

MATCH = "trim(regexp_replace(regexp_replace(lower(raw_text), '\\s+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'))"


def d20(tag: str) -> str:
    return f"({h(tag)} % 20)"


ANNOTATIONS = f"""annotations AS (SELECT report_id, description, label, 'derived_' || substr(sha256({MATCH}), 1, 16) AS duplicate_group_id,
  CASE WHEN {d20('s')} = 0 THEN 'draft' WHEN {d20('s')} < 5 THEN 'pending' ELSE 'Completed' END AS annotation_status,
  CASE WHEN {d20('t')} = 0 THEN 'MAYBE' WHEN {d20('t')} < 9 THEN 'yes' WHEN {d20('t')} < 17 THEN 'NO' ELSE 'UNCERTAIN' END AS sif_potential,
  CASE WHEN {d20('u')} = 0 THEN ' ' ELSE 'reason' END AS sif_reason, CASE WHEN {d20('e')} = 0 THEN NULL ELSE 'evidence' END AS evidence_text,
  CASE WHEN {d20('f')} = 0 THEN 'SURE' ELSE ['HIGH', 'MEDIUM', 'low'][({h('f')} % 3) + 1] END AS annotator_confidence,
  CASE WHEN {d20('g')} = 0 THEN '' ELSE 'annotator' END AS annotator_id,
  CASE WHEN {d20('k')} = 0 THEN NULL ELSE '2024-01-01T00:00:00' END AS annotated_at_utc FROM reports)"""

ADJUDICATIONS = """adjudications AS (SELECT 'report_' || printf('%06d', doc_id) AS report_id, CASE WHEN toxic = 0 THEN 'completed' ELSE 'pending' END AS adjudication_status,
  CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS adjudication_label, CASE WHEN quality = 1 THEN 'reason' ELSE '' END AS adjudication_reason,
  CASE WHEN quality = 1 THEN 'HIGH' ELSE 'none' END AS adjudication_confidence, 'adjudicator' AS adjudicator_id,
  CASE WHEN toxic = 0 THEN '2024-02-01T00:00:00' END AS adjudicated_at_utc FROM labels)"""

NORM = "lower(trim(regexp_replace(description, '\\s+', ' ', 'g')))"
SQUEEZE = "trim(regexp_replace(description, '\\s+', ' ', 'g'))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def alternation(patterns) -> str:
    """One pattern for presence: the union of the list."""
    return "|".join(f"(?:{p})" for p in patterns)


def present(patterns, text: str = "t") -> str:
    return f"regexp_matches({text}, {q(alternation(patterns))})"


def first(patterns, text: str = "t") -> str:
    """Evidence of the first pattern in list order; the position of the hit in the list decides."""
    tried = ", ".join(f"regexp_extract({text}, {q(p)})" for p in patterns)
    return f"list_filter([{tried}], lambda x: x <> '')[1]"


def names_list(bank, text: str = "t") -> str:
    """Sorted names of the categories that hit, by alternation."""
    cases = ", ".join(f"CASE WHEN {present(p, text)} THEN {q(c)} END" for c, p in sorted(bank.items()))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def evidence_list(bank, names: str, text: str = "t") -> str:
    """'name: evidence' for the categories in the names list."""
    cases = ", ".join(
        f"CASE WHEN list_contains({names}, {q(c)}) THEN {q(c + ': ')} || {first(p, text)} END" for c, p in sorted(bank.items())
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def joined(expr: str, separator: str = " | ") -> str:
    return f"coalesce(array_to_string({expr}, {q(separator)}), '')"


def r9(expr: str) -> str:
    return f"round({expr}, 9)"
