"""Overview, density, distribution, coverage and audit aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.ordered import exact_quantiles, keep_first
from hazardloom.functions.text import clean, lenient_timestamp, level_number, percent, strip, tokens
from hazardloom.operators.triage import PRIORITIES


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def rule_counts(df: DataFrame, candidates: str = "rule_candidates") -> DataFrame:
    """Reports per candidate rule."""
    return (
        df.select(F.explode(candidates).alias("c"))
        .groupBy(F.col("c.rule").alias("rule"))
        .agg(F.count(F.lit(1)).alias("reports"))
    )


def overview(df: DataFrame, p: str = "p") -> DataFrame:
    """One row: score threshold counts, mean, exact median, priorities, signal shares."""
    score = F.col(p)
    n = F.count(F.lit(1))
    numbers = df.agg(
        n.alias("records"),
        count_where(score >= 0.5).alias("model_yes_ge_0_50"),
        count_where(score >= 0.75).alias("high_ge_0_75"),
        count_where(score >= 0.9).alias("very_high_ge_0_90"),
        F.round(F.avg(score), 4).alias("mean_probability"),
        count_where(F.col("complete_pathway") == 1).alias("complete_pathways"),
        F.round(percent(count_where(F.col("hazard_signal") == 1), n), 4).alias("hazard_signal_pct"),
        F.round(percent(count_where(F.col("exposure_signal") == 1), n), 4).alias("exposure_signal_pct"),
        F.round(percent(count_where(F.col("pathway_signal") == 1), n), 4).alias("pathway_signal_pct"),
        *[count_where(F.col("review_priority") == x).alias(x.lower()) for x in PRIORITIES],
        F.coalesce(F.bool_or(clean(F.col("activity")).isNotNull()), F.lit(False)).alias("activity_metadata_available"),
    )
    median = exact_quantiles(df.select(p), [], p, {"m": 0.5}).select(F.round("m", 4))
    return numbers.withColumn("median_probability", median.scalar())


def domain(df: DataFrame, values: list[str], name: str) -> DataFrame:
    """A literal table of the allowed values."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def priority_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("review_priority").agg(F.count(F.lit(1)).alias("n"))
    full = domain(df, PRIORITIES, "review_priority").join(counts, "review_priority", "left")
    return full.select("review_priority", F.coalesce("n", F.lit(0)).alias("records"))


def top_tokens(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Most frequent list items of a delimited column; ties by name."""
    return (
        df.select(F.explode(tokens(F.col(column))).alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), "category")
        .limit(limit)
    )


def density(df: DataFrame, column: str, limit: int, p: str = "p") -> DataFrame:
    """Records, model flags, flag rate and mean score per value of a dimension, highest rate first."""
    value = clean(F.col(column))
    grouped = (
        df.where(value.isNotNull())
        .groupBy(value.alias("category"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            count_where(F.col(p) >= 0.5).alias("model_flags"),
            F.round(F.avg(p), 4).alias("avg_probability"),
        )
    )
    rate = F.col("model_flags") / F.col("records")
    return (
        grouped.withColumn("_rate", rate)
        .orderBy(F.desc("_rate"), F.desc("records"), "category")
        .limit(limit)
        .withColumn("model_flag_rate", F.round("_rate", 4))
        .drop("_rate")
    )


def review_stats(reviews: DataFrame) -> DataFrame:
    """Total, by decision and by reviewer from one pass over the log."""
    sets = reviews.groupingSets([[], ["decision"], ["reviewer"]], "decision", "reviewer").agg(
        F.count(F.lit(1)).alias("reviews"), F.grouping_id().alias("_g")
    )
    scope = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "decision").otherwise("reviewer")
    return sets.select(scope.alias("scope"), F.coalesce("decision", "reviewer", F.lit("all")).alias("value"), "reviews")


def value_counts(df: DataFrame, columns: list[str], top: int | None, empty: str = "<NULL>", blank_is_empty: bool = False) -> DataFrame:
    """Long form (column, value, records): the most frequent values of each column, or all."""
    cell = lambda c: F.coalesce(clean(F.col(c)) if blank_is_empty else F.col(c).cast("string"), F.lit(empty))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("value")) for c in columns])
    counts = (
        df.select(F.explode(pairs).alias("x"))
        .groupBy(F.col("x.column").alias("column"), F.col("x.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return counts if top is None else keep_first(counts, ["column"], [F.desc("records"), F.col("value")], top)


def quality_report(df: DataFrame, text: str, id_column: str, timestamp: str) -> DataFrame:
    """One row: text emptiness, uniqueness and lengths, timestamp and id quality."""
    trimmed = F.coalesce(strip(F.col(text)), F.lit(""))
    stamp = lenient_timestamp(F.col(timestamp))
    length = F.length(trimmed)
    base = df.select(trimmed.alias("_s"), stamp.alias("_ts"), F.col(id_column).alias("_id"))
    main = base.agg(
        F.count(F.lit(1)).alias("records"),
        count_where(F.col("_s") == "").alias("empty_description_count"),
        F.min(F.length("_s")).cast("bigint").alias("min_characters"),
        F.max(F.length("_s")).cast("bigint").alias("max_characters"),
        F.round(F.avg(F.length("_s")), 2).alias("mean_characters"),
        count_where(F.col("_ts").isNull()).alias("invalid_timestamps"),
        F.min("_ts").alias("first_timestamp"),
        F.max("_ts").alias("last_timestamp"),
    )
    texts = base.groupBy(F.sha2("_s", 256).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ids = base.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    median = exact_quantiles(base.select(F.length("_s").alias("l")), [], "l", {"m": 0.5})
    return main.withColumns(
        {
            "median_characters": median.scalar(),
            "unique_description_count": texts.agg(F.count(F.lit(1))).scalar(),
            "duplicate_description_records": texts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).scalar(),
            "duplicate_report_ids": ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar(),
        }
    )


def crosstab_margins(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Long cross-tab with 'All' margins."""
    cubed = df.cube(rows, columns).agg(
        F.count(F.lit(1)).alias("records"), F.grouping(rows).alias("_r"), F.grouping(columns).alias("_c")
    )
    return cubed.select(
        F.when(F.col("_r") == 1, "All").otherwise(F.col(rows)).alias(rows),
        F.when(F.col("_c") == 1, "All").otherwise(F.col(columns)).alias(columns),
        "records",
    )


def severity_escalation(df: DataFrame, actual: str, potential: str) -> DataFrame:
    higher = level_number(F.col(potential)) > level_number(F.col(actual))
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        count_where(higher).alias("higher_potential"),
        F.round(count_where(higher) / F.count(F.lit(1)), 9).alias("share"),
    )


def batch_audit(df: DataFrame, p: str = "p") -> DataFrame:
    """One pass over scored, tagged, v1.2-prioritised rows: score, coverage, context, conflict and queue counts."""
    s = F.col(p)
    n = F.count(F.lit(1))
    hazard, exposure, pathway = (F.col(c) != "" for c in ("hazards", "exposures", "pathways"))
    complete = F.col("complete_pathway") == 1
    status = F.lower(F.col("sif_context_status"))
    weak = status.isin("unknown", "context_limited")
    conflict = F.col("model_evidence_conflicts") != ""
    pct = lambda c: F.round(percent(count_where(c), n), 6)
    median = exact_quantiles(df.select(p), [], p, {"m": 0.5}).select(F.round("m", 6))
    return df.agg(
        n.alias("records"),
        count_where(s >= 0.5).alias("predicted_yes"),
        count_where(s < 0.5).alias("predicted_no"),
        count_where(s >= 0.75).alias("high_ge_0_75"),
        count_where(s >= 0.8).alias("high_ge_0_80"),
        count_where((s >= 0.5) & (s < 0.75)).alias("moderate_0_50_to_0_75"),
        F.round(F.avg(s), 6).alias("mean_probability"),
        pct(hazard).alias("hazard_signal_pct"),
        pct(exposure).alias("exposure_signal_pct"),
        pct(pathway).alias("pathway_signal_pct"),
        pct(complete).alias("complete_pathway_pct"),
        pct(~hazard).alias("no_hazard_evidence_pct"),
        pct(~exposure).alias("no_exposure_evidence_pct"),
        pct(~pathway).alias("no_pathway_evidence_pct"),
        count_where(status == "unknown").alias("unknown_context"),
        count_where(status == "context_limited").alias("limited_context"),
        count_where(status == "sufficient_context").alias("sufficient_context"),
        count_where(conflict).alias("any_conflict"),
        pct(conflict).alias("any_conflict_pct"),
        count_where((s >= 0.75) & weak).alias("high_score_and_unknown_or_limited"),
        count_where((s >= 0.75) & ~pathway).alias("high_score_and_no_pathway"),
        count_where((s >= 0.75) & complete).alias("high_score_and_complete_pathway"),
        *[count_where(F.col("review_priority") == x).alias(x.lower() + "_records") for x in PRIORITIES],
        *[pct(F.col("review_priority") == x).alias(x.lower() + "_pct") for x in PRIORITIES],
    ).withColumn("median_probability", median.scalar())


def evidence_coverage(df: DataFrame) -> DataFrame:
    """Records and share per signal."""
    signals = {"hazard": "hazard_signal", "exposure": "exposure_signal", "pathway": "pathway_signal", "complete_pathway": "complete_pathway"}
    pairs = F.array(*[F.struct(F.lit(k).alias("signal"), (F.col(c) == 1).alias("on")) for k, c in signals.items()])
    return (
        df.select(F.explode(pairs).alias("x"))
        .groupBy(F.col("x.signal").alias("signal"))
        .agg(
            count_where(F.col("x.on")).alias("records"),
            F.round(percent(count_where(F.col("x.on")), F.count(F.lit(1))), 6).alias("pct"),
        )
    )


def tier_metrics(df: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """Per priority: records, positives, negatives, gold-positive rate, mean and exact median score."""
    counts = df.groupBy("review_priority").agg(
        F.count(F.lit(1)).alias("records"),
        count_where(F.col(truth) == 1).alias("yes"),
        count_where(F.col(truth) == 0).alias("no"),
        F.round(F.avg(F.col(truth).cast("double")), 9).alias("gold_positive_rate"),
        F.round(F.avg(p), 9).alias("mean_probability"),
    )
    medians = exact_quantiles(df.select("review_priority", p), ["review_priority"], p, {"median_probability": 0.5})
    full = domain(df, PRIORITIES, "review_priority").join(counts, "review_priority", "left").join(medians, "review_priority", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("records", "yes", "no")})


def evidence_summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("records"),
        *[F.round(F.avg(F.col(f"{s}_signal")), 9).alias(f"{s}_rate") for s in ("hazard", "exposure", "pathway")],
        F.round(F.avg("complete_pathway"), 9).alias("complete_rate"),
        *[
            count_where(F.col("pathway_assessment") == w).alias(w.lower())
            for w in ("SUPPORTED", "PARTIAL", "WEAK", "NONE")
        ],
        *[
            count_where(F.col("sif_context_status") == w).alias(w.lower())
            for w in ("CONTEXT_AGAINST_SIF", "SUFFICIENT_CONTEXT", "CONTEXT_LIMITED", "UNKNOWN")
        ],
        count_where(F.col("conflict_type").contains("FALSE_POSITIVE")).alias("false_positives"),
        count_where(F.col("conflict_type").contains("FALSE_NEGATIVE")).alias("false_negatives"),
    )
