"""Sentence-level evidence: long spans, control mentions, pathway inspection, precursor features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.banks import audits, precursors
from hazardloom.functions import matching as m
from hazardloom.functions import text as tx
from hazardloom.functions.ordered import keep_first


def sentence_rows(df: DataFrame, text: str = "description", squeeze: bool = True) -> DataFrame:
    """One row per sentence with its 0-based index; long narratives become many small rows."""
    body = tx.squeeze(F.col(text)) if squeeze else F.col(text)
    rows = df.withColumn("_s", m.staged(tx.sentences(body)))
    return rows.select("report_id", F.posexplode("_s").alias("sentence_index", "sentence")).withColumn("_low", m.staged(F.lower("sentence")))


def evidence_spans(df: DataFrame, text: str = "description") -> DataFrame:
    """(id, evidence type, sentence index, name, sentence, terms) for every family that hits a sentence."""
    needed, entries = m.bank_patterns(*precursors.SPANS.values()), []
    for kind, bank in precursors.SPANS.items():
        for name, patterns in bank.items():
            terms = F.array_sort(F.array_distinct(m.all_terms(F.col("_low"), patterns, F.col("_seen"))))
            entries.append(F.struct(F.lit(kind).alias("evidence_type"), F.lit(name).alias("name"), terms.alias("terms")))
    rows = sentence_rows(df, text).withColumn("_seen", m.staged(m.begun_words(F.col("_low"), needed)))
    if all(m.required_words(p) for p in needed):  # a sentence without any of the words has no hit
        rows = rows.where("_seen <> ''")
    rows = rows.withColumn("_spans", m.staged(F.filter(F.array(*entries), lambda x: F.size(x.terms) > 0)))
    return rows.select("report_id", "sentence_index", "sentence", F.explode("_spans").alias("x")).select(
        "report_id", "x.evidence_type", "sentence_index", "x.name", "sentence", F.array_join("x.terms", " | ").alias("matched_terms")
    )


def span_counts(spans: DataFrame) -> DataFrame:
    """Span rows per report, one column per evidence type."""
    kinds = list(precursors.SPANS)
    return spans.groupBy("report_id").pivot("evidence_type", kinds).count().fillna(0, kinds)


def top_mechanisms(spans: DataFrame) -> DataFrame:
    """The three most frequent precursor mechanisms per report; ties by name."""
    counts = spans.where("evidence_type = 'precursor'").groupBy("report_id", "name").agg(F.count(F.lit(1)).alias("n"))
    best = keep_first(counts, ["report_id"], [F.desc("n"), F.col("name")], 3)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name")))  # three items at most
    return best.groupBy("report_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), "; ").alias("top_mechanisms"))


def barrier_audit(df: DataFrame, text: str = "description") -> DataFrame:
    """Distinct control and gap categories mentioned in any sentence, with counts."""
    rows = df.withColumn("_s", m.staged(F.transform(tx.sentences(F.col(text)), F.lower)))
    return (
        rows.withColumn("_c", m.staged(_mentions(audits.CONTROLS)))
        .withColumn("_g", m.staged(_mentions(audits.GAPS)))
        .select(
            *df.columns,
            F.array_join("_c", " | ").alias("control_categories_mentioned"),
            F.array_join("_g", " | ").alias("barrier_gap_categories_mentioned"),
            F.size("_c").alias("control_category_count"),
            F.size("_g").alias("barrier_gap_category_count"),
        )
    )


def _mentions(bank: dict) -> Column:
    def in_a_sentence(patterns: list[str]) -> Column:
        return F.exists("_s", lambda s: m.any_of(s, patterns))

    return F.array_compact(F.array(*[F.when(in_a_sentence(bank[c]), c) for c in sorted(bank)]))


# Recommendation per assessment.
RECOMMENDATIONS = {
    "SUPPORTED_BY_NARRATIVE_SIGNALS": "Manual adjudication: narrative contains hazard + exposure + pathway signals.",
    "PARTIALLY_SUPPORTED": "Manual adjudication: check the missing hazard/exposure/pathway ingredient.",
    "WEAK_SIGNAL": "Manual adjudication: weak narrative signal; inspect context carefully.",
    "NO_CLEAR_PATHWAY_SIGNAL": "Manual adjudication: no clear precursor pathway signal detected.",
}


def pathway_inspection(df: DataFrame, text: str = "description") -> DataFrame:
    """Categories and terms of four families, gap words, strength, assessment and recommendation."""
    families = {"hazard": audits.HAZARDS, "exposure": audits.EXPOSURES, "pathway": audits.PATHWAYS, "control": audits.INSPECTION_CONTROLS}
    rows = df.withColumn("_t", m.staged(tx.squeeze(F.col(text)))).withColumn("_low", m.staged(F.lower("_t")))

    def family(bank: dict) -> Column:
        entries = [F.struct(F.lit(c).alias("category"), _spelled(bank[c]).alias("terms")) for c in sorted(bank)]
        return F.filter(F.array(*entries), lambda x: F.size(x.terms) > 0)

    needed = [*m.bank_patterns(*families.values()), *audits.NEGATIONS]
    rows = rows.withColumn("_seen", m.staged(m.begun_words(F.col("_low"), needed)))
    rows = rows.withColumns({"_" + k: m.staged(family(b)) for k, b in families.items()})
    rows = rows.withColumn("_gaps", m.staged(_spelled(audits.NEGATIONS)))
    out = {}
    for k in families:
        out[f"{k}_categories"] = F.array_join(F.transform("_" + k, lambda x: x.category), " | ")
        out[f"{k}_terms"] = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("_" + k, lambda x: x.terms)))), " | ")
    out["negation_or_gap_signals"] = F.array_join(F.array_sort(F.array_distinct("_gaps")), " | ")
    out["sentence_count"] = F.size(tx.sentences(F.col("_t")))
    strength = sum(((F.size("_" + k) > 0).cast("int") for k in ("hazard", "exposure", "pathway")), F.lit(0))
    rows = rows.withColumns({**out, "pathway_strength": strength})
    words = list(RECOMMENDATIONS)
    word = F.element_at(F.array(*[F.lit(w) for w in reversed(words)]), F.col("pathway_strength") + 1)
    advice = F.element_at(F.array(*[F.lit(RECOMMENDATIONS[w]) for w in reversed(words)]), F.col("pathway_strength") + 1)
    rows = rows.withColumns({"pathway_assessment": word, "review_recommendation": advice})
    return rows.select([c for c in rows.columns if not c.startswith("_")])


def _spelled(patterns: list[str]) -> Column:
    """First hit per pattern in the spelling of the text."""

    def one(p: str) -> Column:
        found = F.nullif(F.regexp_extract(F.col("_t"), m.any_case(p), 0), F.lit(""))
        guard = m.may_hit(F.col("_seen"), p)
        return found if guard is None else F.when(guard, found)

    return F.array_compact(F.array(*[one(p) for p in patterns]))


def precursor_feature_names() -> list[str]:
    names = ["narrative_chars", "narrative_words"]
    names += [prefix + k for prefix, bank in precursors.FEATURES.items() for k in bank]
    names += ["max_height_m", "significant_height_signal", "low_height_signal", "max_voltage_v", "high_voltage_signal"]
    return names + [f"body_{b}_mentioned" for b in precursors.BODY_PARTS] + list(precursors.INTERACTIONS)


def precursor_features(df: DataFrame, text: str = "description") -> DataFrame:
    """The narrative-only feature table; heights and voltages stay null where none is given."""
    low, seen = F.col("_text"), F.col("_seen")
    needed = [*m.bank_patterns(*precursors.FEATURES.values()), *[rf"\b{b}\b" for b in precursors.BODY_PARTS]]
    flags = {p + k: m.staged(m.any_of(low, pats, seen).cast("int")) for p, bank in precursors.FEATURES.items() for k, pats in bank.items()}
    flags |= {f"body_{b}_mentioned": m.staged(m.hits(low, rf"\b{b}\b", seen).cast("int")) for b in precursors.BODY_PARTS}
    flags |= {
        "narrative_chars": m.staged(F.length(low)),
        "narrative_words": m.staged(tx.word_count(low)),
        "max_height_m": m.staged(F.when(m.may_hit(low, precursors.HEIGHT), tx.max_number(low, precursors.HEIGHT))),
        "max_voltage_v": m.staged(tx.max_number(low, precursors.VOLTAGE)),
    }
    rows = df.withColumn("_text", m.staged(tx.norm(F.col(text)))).withColumn("_seen", m.staged(m.begun_words(low, needed))).withColumns(flags)
    extra = {
        "significant_height_signal": F.coalesce(F.col("max_height_m") >= 2.0, F.lit(False)),
        "low_height_signal": F.coalesce(F.col("max_height_m") < 1.0, F.lit(False)),
        "high_voltage_signal": F.coalesce(F.col("max_voltage_v") >= 50, F.lit(False)),
        **{k: (F.col(a) == 1) & (F.col(b) == 1) for k, (a, b) in precursors.INTERACTIONS.items()},
    }
    rows = rows.withColumns({k: v.cast("int") for k, v in extra.items()})
    return rows.select("report_id", *precursor_feature_names())


def ranking_audit(df: DataFrame, counts: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """Span counts beside scores (absent counts are zero), six review flags and the review score."""
    kinds = list(precursors.SPANS)
    rows = df.join(counts, "report_id", "left").fillna(0, kinds)
    score = F.col(p)
    bare = F.col("precursor") == 0
    return rows.withColumns(
        {
            "flag_no_precursor_evidence": bare,
            "flag_high_score_no_precursor": (score >= 0.5) & bare,
            "flag_lsr_without_lsr_evidence": (F.col("lsr_candidate_count") > 0) & (F.col("lsr") == 0),
            "flag_barrier_without_barrier_evidence": (F.col("barrier_evidence_count") > 0) & (F.col("barrier") == 0),
            "flag_high_score_label_no": (score >= 0.5) & (F.col(truth) == 0),
            "flag_low_score_label_yes": (score < 0.5) & (F.col(truth) == 1),
            "review_score": F.round(score + F.lit(0.02) * F.col("precursor") + F.lit(0.02) * F.col("barrier") + F.lit(0.01) * F.col("lsr"), 9),
        }
    )


FLAGS = [
    "flag_high_score_no_precursor", "flag_lsr_without_lsr_evidence", "flag_barrier_without_barrier_evidence",
    "flag_high_score_label_no", "flag_low_score_label_yes",
]
