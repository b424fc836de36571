"""Rule-candidate mapping: text terms plus evidence cues, or extraction labels plus keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.banks import rules as bank
from hazardloom.functions.matching import staged


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _best_first(a: Column, b: Column) -> Column:
    return F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.rule < b.rule, -1).otherwise(1)


def rule_candidates(
    df: DataFrame, rules: dict | None = None, text: str = "description", sort_terms: bool = True, keep: int = 3
) -> DataFrame:
    """Adds rule_candidates: the best rules by (score desc, name) as (rule, score, terms).

    Terms match as plain substrings of the lower-cased text, and cues as substrings of the
    rendered evidence lists, so 'fall' also hits 'falling'."""
    rules = rules or bank.CURRENT
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = []
    for name in sorted(rules):
        rule = rules[name]
        terms = sorted(set(rule["terms"])) if sort_terms else rule["terms"]
        matched = F.filter(F.array(*[F.when(F.contains(F.col("_low"), F.lit(x)), x) for x in terms]), lambda x: x.isNotNull())
        cues = [F.contains(F.col(c), F.lit(x)) for c in ("hazards", "exposures", "pathways") for x in rule.get(c, [])]
        cues += [F.contains(F.col("_low"), F.lit(x)) for x in rule.get("words", [])]
        base = F.least(F.lit(0.6), F.lit(0.2) * F.size(matched))
        score = F.round(F.least(F.lit(1.0), base + F.when(_any(cues), 0.4).otherwise(0.0)), 4)
        scored.append(F.struct(F.lit(name).alias("rule"), score.alias("score"), F.slice(matched, 1, 8).alias("terms")))
    kept = F.filter(F.array(*scored), lambda x: x.score > 0)
    return (
        df.withColumn("_low", staged(low))
        .withColumn("_scored", staged(kept))
        .withColumn("rule_candidates", F.slice(F.array_sort("_scored", _best_first), 1, keep))
        .drop("_low", "_scored")
    )


def render_candidates(candidates: Column) -> Column:
    """'rule=0.8[term,term]; ...' in rank order."""
    return F.array_join(
        F.transform(
            candidates,
            lambda x: F.concat(
                x.rule, F.lit("="), x.score.cast("decimal(6,4)").cast("string"), F.lit("["), F.array_join(x.terms, ","), F.lit("]")
            ),
        ),
        "; ",
    )


def label_candidates(df: DataFrame, rules: dict, line_of_fire_needs_exposure: bool) -> DataFrame:
    """Adds label_candidates from an extraction table: .35 per hazard or exposure label, .20 per
    activity, .08 per keyword in the evidence text; kept from .35, top three by score then rule order."""
    evidence = F.lower(F.col("evidence_text"))
    scored = []
    for order, (name, rule) in enumerate(rules.items()):
        parts = [(F.array_contains(F.col("_hazards"), x), 0.35) for x in rule.get("hazards", [])]
        parts += [(F.array_contains(F.col("_exposures"), x), 0.35) for x in rule.get("exposures", [])]
        parts += [(F.array_contains(F.col("_activities"), x), 0.20) for x in rule.get("activities", [])]
        parts += [(F.contains(evidence, F.lit(x)), 0.08) for x in rule.get("keywords", [])]
        score = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in parts])
        if line_of_fire_needs_exposure and name == "Line of Fire":
            explicit = F.array_contains(F.col("_exposures"), "Line-of-fire exposure")
            score = F.when(explicit, score).otherwise(score * 0.25)
        scored.append(
            F.struct(F.lit(name).alias("rule"), F.round(score, 9).alias("score"), F.lit(order).alias("ord"))
        )
    kept = F.filter(F.array(*scored), lambda x: x.score >= 0.35)
    ranked = F.array_sort(
        kept,
        lambda a, b: F.when(F.least(a.score, F.lit(1.0)) > F.least(b.score, F.lit(1.0)), -1)
        .when(F.least(a.score, F.lit(1.0)) < F.least(b.score, F.lit(1.0)), 1)
        .otherwise(a.ord - b.ord),
    )
    top = F.transform(
        F.slice(ranked, 1, 3),
        lambda x: F.struct(x.rule.alias("rule"), F.round(F.least(x.score, F.lit(1.0)), 3).alias("score")),
    )
    return df.withColumn("label_candidates", top)
