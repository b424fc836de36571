"""Batch selection: the greedy passes as bounded per-group ranks, and active-learning scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.functions.ordered import keep_first
from hazardloom.functions.text import norm

# Gold-set quota per severity band.
GOLD_QUOTAS = {"high": 10, "medium_high": 15, "medium": 15, "lower": 10}


def _band(level: str, bands: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, levels in bands.items():
        out = F.when(F.col(level).isin(levels), name).otherwise(out)
    return out


def select_gold_set(df: DataFrame) -> DataFrame:
    """Per band: one row of every department first, then the rest, both by rarity of department
    and department/risk pair, severe outcome, short text, id; cut to the band's quota."""
    bands = {"lower": ["I", "II"], "medium": ["III"], "medium_high": ["IV"], "high": ["V", "VI"]}
    rows = df.withColumn("band", _band("potential_level", bands)).where(F.col("band").isNotNull())
    rows = rows.withColumn("chars", F.length("description")).drop("description")
    departments = rows.groupBy("band", "department").agg(F.count(F.lit(1)).alias("department_frequency"))
    pairs = rows.groupBy("band", "department", "risk").agg(F.count(F.lit(1)).alias("combo_frequency"))
    rows = rows.join(departments, ["band", "department"]).join(pairs, ["band", "department", "risk"])
    order = [F.col("department_frequency"), F.col("combo_frequency"), F.desc("actual_number"), F.col("chars"), F.col("report_id")]
    first = keep_first(rows, ["band", "department"], order).withColumn("_pass", F.lit(1))
    # with fewer departments than the quota, twice the quota holds enough other rows
    fill = keep_first(rows, ["band"], order, 2 * max(GOLD_QUOTAS.values()))
    fill = fill.join(first.select("report_id"), "report_id", "left_anti").withColumn("_pass", F.lit(2))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in GOLD_QUOTAS.items() for x in kv]), F.col("band"))
    place = F.row_number().over(Window.partitionBy("band").orderBy("_pass", *order))
    picked = keep_first(first.unionByName(fill), ["band"], [F.col("_pass"), *order], max(GOLD_QUOTAS.values()))
    return picked.withColumn("place", place).where(F.col("place") <= quota).select("report_id", "band", "place")


def select_calibration_02(df: DataFrame) -> DataFrame:
    """Four short low rows, three medium rows nearest 350 characters, three high rows by department and risk."""
    rows = df.withColumn("chars", F.length("description"))
    low = rows.where(F.col("potential_level").isin("I", "II")).orderBy("chars", "department", "report_id").limit(4)
    medium = rows.where(F.col("potential_level") == "III").orderBy(F.abs(F.col("chars") - 350), "risk", "report_id").limit(3)
    high = rows.where(F.col("potential_level").isin("IV", "V", "VI")).orderBy("department", "risk", "chars", "report_id").limit(3)
    tagged = [x.select("report_id", F.lit(n).alias("stratum")) for n, x in (("low", low), ("medium", medium), ("high", high))]
    return reduce(DataFrame.unionByName, tagged)


def select_calibration_03(df: DataFrame, quota: int = 5) -> DataFrame:
    """Per stratum: new departments first, then new risks among the rest, then the rest.

    Later passes only act while fewer departments than the quota exist, so the first quota rows
    per risk, and three quotas per stratum, hold every row they can pick."""
    bands = {"lower": ["I", "II"], "medium": ["III"], "high": ["IV"], "very_high": ["V", "VI"]}
    rows = df.withColumn("stratum", _band("potential_level", bands)).where(F.col("stratum").isNotNull())
    rows = rows.select("report_id", "stratum", "department", "risk", F.length("description").alias("chars"))
    order = [F.col(c) for c in ("department", "risk", "chars", "report_id")]
    one = keep_first(rows, ["stratum", "department"], order)
    two = keep_first(rows, ["stratum", "risk"], order, quota).join(one.select("report_id"), "report_id", "left_anti")
    two = keep_first(two, ["stratum", "risk"], order)
    three = keep_first(rows, ["stratum"], order, 3 * quota)
    three = three.join(one.select("report_id"), "report_id", "left_anti").join(two.select("report_id"), "report_id", "left_anti")
    passes = [x.withColumn("_pass", F.lit(i)) for i, x in enumerate((one, two, three), start=1)]
    return keep_first(reduce(DataFrame.unionByName, passes), ["stratum"], [F.col("_pass"), *order], quota).select("report_id", "stratum")


# Boundary rules in order; the label or the text pattern that selects.
BOUNDARY_RULES = [
    ("existing_uncertain", "UNCERTAIN", None),
    ("chemical_counterfactual", None, r"higher concentration|larger volume|greater exposure|longer contact|worse-case|worst-case|more hazardous"),
    ("effective_barrier", None, r"protection system acted|protection system|immediately|isolat|lockout|guard|shield"),
    ("low_energy_cut", None, r"\bfinger\b|glass|puncture|guillotine|mesh|cut"),
    ("short_or_unclear_fall", None, r"\b1\s*m\b|\b1m\b|\b2\.5\s*m\b|\b2\.5m\b|\bfall\b|scaffold|ladder"),
    ("strong_yes_boundary", "YES", r"could have|could potentially|larger|greater|different|similar release"),
]


def select_boundary(df: DataFrame, total: int = 10) -> DataFrame:
    """The first rule that holds decides; rows by rule order, then id, up to the total."""
    text = F.concat_ws(" ", norm(F.col("description")), norm(F.col("sif_reason")))
    label = F.upper(F.trim("sif_potential"))
    rank, name = F.lit(len(BOUNDARY_RULES) + 1), F.lit("manual_fill")
    for i, (rule, wanted, pattern) in reversed(list(enumerate(BOUNDARY_RULES, start=1))):
        holds = F.lit(True)
        if wanted:
            holds = holds & (label == wanted)
        if pattern:
            holds = holds & F.col("_text").rlike(pattern)
        rank = F.when(holds, i).otherwise(rank)
        name = F.when(holds, rule).otherwise(name)
    rows = df.withColumn("_text", text).select("report_id", rank.alias("rule_order"), name.alias("boundary_selection_rule"))
    return rows.orderBy("rule_order", "report_id").limit(total)


def _scaled(df: DataFrame, column: str) -> Column:
    """Min-max over the whole table by scalar subqueries; zero when constant."""
    low, high = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return F.when(high == low, F.lit(0.0)).otherwise((F.col(column) - low) / (high - low))


# Why a report is selected.
SELECTION_REASONS = {
    "first": "TF-IDF YES / Transformer NO disagreement",
    "second": "TF-IDF NO / Transformer YES disagreement",
    "boundary": "Near decision boundary",
    "apart": "Strong model disagreement",
    "unsure": "High combined uncertainty",
}


def active_learning_scores(df: DataFrame, first: str = "p", second: str = "p2") -> DataFrame:
    """Mean of two models, disagreement, boundary uncertainty, weighted ranking score and reason."""
    a, b = F.col(first), F.col(second)
    base = df.withColumn("hybrid_probability", F.lit(0.5) * a + F.lit(0.5) * b).withColumn("model_disagreement", F.abs(a - b))
    unsure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.lit(2.0) * F.abs(F.col("hybrid_probability") - F.lit(0.5))))
    base = base.withColumn("boundary_uncertainty", unsure)
    spread = _scaled(base, "model_disagreement")
    ranking = F.lit(0.45) * spread + F.lit(0.35) * _scaled(base, "boundary_uncertainty") + F.lit(0.20) * spread
    reason = (
        F.when((a >= 0.5) & (b < 0.5), SELECTION_REASONS["first"])
        .when((a < 0.5) & (b >= 0.5), SELECTION_REASONS["second"])
        .when(F.abs(F.col("hybrid_probability") - 0.5) <= 0.08, SELECTION_REASONS["boundary"])
        .when(F.col("model_disagreement") >= 0.2, SELECTION_REASONS["apart"])
        .otherwise(SELECTION_REASONS["unsure"])
    )
    return base.withColumns({"ranking_score": F.round(ranking, 9), "selection_reason": reason})


def select_active_batch(scored: DataFrame, risk: str | None = "risk", size: int = 30, cap: int = 4) -> DataFrame:
    """Strongest disagreements with at most cap rows per risk, then the best ranked of the others.

    The capped pass exhausts every risk it does not fill, so a second capped pass adds nothing."""
    strong = [F.desc("model_disagreement"), F.col("report_id")]
    ranked = [F.desc("ranking_score"), F.desc("model_disagreement"), F.desc("boundary_uncertainty"), F.col("report_id")]
    capped = keep_first(scored, [risk], strong, cap) if risk else scored
    one = capped.orderBy(*strong).limit(size).withColumn("_pass", F.lit(1))
    two = scored.orderBy(*ranked).limit(2 * size).join(one.select("report_id"), "report_id", "left_anti").withColumn("_pass", F.lit(2))
    both = one.unionByName(two)
    first = lambda c: F.when(F.col("_pass") == 2, F.col(c))  # noqa: E731  only the second pass goes by it
    order = [F.col("_pass"), F.desc(first("ranking_score")), F.desc("model_disagreement"), F.desc(first("boundary_uncertainty")), F.col("report_id")]
    best = both.orderBy(*order).limit(size)
    place = F.row_number().over(Window.orderBy(*order))  # at most size rows
    return best.withColumn("active_learning_rank", place).drop("_pass")
