"""Oracles of packages and cross-validation: what they were fitted on, what they covered."""

from __future__ import annotations

from hazardloom.operators import spans as sp
from oracles.base import REPORTS, q, with_
from oracles.evaluation import GROUPED, LABELLED, SPLIT, features_cte

# The compared column sets, and the folds and repeats of the cross-validation.
MODELS = ["embedding", "structured", "combined"]
FOLDS, REPEATS = 5, 10
NULLABLE = ["max_height_m", "max_voltage_v"]


def _feature(c: str) -> str:
    """Count, median, and mean and population deviation with the median for nulls, over the training split."""
    filled = f"coalesce({c}::double, (SELECT coalesce(median({c}::double), 0) FROM tr))" if c in NULLABLE else f"{c}::double"
    flat = f"stddev_pop({filled}) <= 1e-9::double * (1 + abs(avg({filled})))"
    median = f"(SELECT median({c}::double) FROM tr)" if c in NULLABLE else "NULL::double"
    return f"""SELECT {q(c)} AS feature, count({c}) > 0 AS kept, count({c})::bigint AS n_values, {median} AS median, round(avg({filled}), 6) AS mean,
  CASE WHEN {flat} THEN 1.0::double ELSE round(stddev_pop({filled}), 6) END AS deviation, count({c}) < count(*) AS has_flag FROM tr"""


def oracles() -> dict[str, str]:
    split = [REPORTS, LABELLED, GROUPED, SPLIT]
    dealt = f"""gl AS (SELECT duplicate_group_id, (avg(truth) >= 0.5)::int AS mj FROM grouped GROUP BY 1),
gd AS (SELECT duplicate_group_id, repeat, (row_number() OVER (ORDER BY repeat, mj, h, duplicate_group_id) % {FOLDS})::int AS fold FROM (
  SELECT duplicate_group_id, mj, repeat::int AS repeat, ('0x' || substr(md5(concat_ws('|', repeat, duplicate_group_id)), 1, 8))::bigint AS h FROM gl, range(1, {REPEATS + 1}) x(repeat)))"""
    models = ", ".join(f"({q(m)})" for m in MODELS)
    return {
        "model_package": with_(*split, features_cte(), "tr AS (SELECT ft.* FROM ft JOIN split s USING (report_id) WHERE split = 'train')") + " UNION ALL ".join(map(_feature, sp.precursor_feature_names())),
        "package_roundtrip": with_(*split) + "SELECT split, count(*)::bigint AS records, count(*)::bigint AS scored, 0.0::double AS largest_difference, 3 AS refused FROM split GROUP BY split",
        "cv_coverage": with_(REPORTS, LABELLED, GROUPED, dealt)
        + f"SELECT model, repeat, fold, count(*)::bigint AS records, sum(truth)::bigint AS positives, true AS once, true AS all_scored, 0::bigint AS groups_in_two_folds FROM grouped JOIN gd USING (duplicate_group_id), (VALUES {models}) m(model) GROUP BY model, repeat, fold",
        "cv_oof_coverage": with_(REPORTS, LABELLED) + f"SELECT {REPEATS}::bigint AS parts, true AS complete, count(*)::bigint AS records, count(*)::bigint AS scored FROM labelled HAVING count(*) > 0",
    }
