"""Sentence-scoped ontology extraction with offsets and lexical confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.banks import ontology_v01 as v01
from hazardloom.banks import ontology_v02 as v02
from hazardloom.banks import ontology_v03 as v03
from hazardloom.functions import matching as m

CONFIDENCE = ["LOW", "MEDIUM", "HIGH"]


def offset_sentences(df: DataFrame, text: str = "description", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sentence with its character offset."""
    rows = df.withColumn("_s", m.staged(m.sentence_offsets(F.coalesce(F.col(text), F.lit("")))))
    long = rows.select("report_id", *keep, F.explode("_s").alias("s")).select("report_id", *keep, "s.start", "s.sentence")
    return long.withColumn("_low", m.staged(F.lower("sentence")))


def _hit(family: str, key: str, label: str, patterns: list[str]) -> Column:
    """The first pattern in bank order that hits the sentence, with its place."""
    sentence, low = F.col("sentence"), F.col("_low")

    def one(p: str) -> Column:
        at = F.regexp_instr(sentence, F.lit(m.any_case(p)))
        found = F.when(at > 0, F.struct(F.regexp_extract(sentence, m.any_case(p), 0).alias("evidence"), at.alias("at")))
        guard = m.may_hit(low, p)
        return found if guard is None else F.when(guard, found)

    place = F.coalesce(*[one(p) for p in patterns])
    return F.struct(F.lit(family).alias("family"), F.lit(key).alias("ontology_key"), F.lit(label).alias("label"), place.alias("place"))


def _has_phrase(evidence: Column, phrases: list[str]) -> Column:
    low = F.lower(evidence)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in phrases])


def _words(evidence: Column) -> Column:
    return F.regexp_count(evidence, F.lit(r"\S+"))


def _lexical_rank(evidence: Column, priority: Column) -> Column:
    return F.when(_has_phrase(evidence, v01.STRONG), 3).when(_words(evidence) >= 2, 2).otherwise(1)


def _priority_rank(bank):
    """Confidence from the rule's priority, strong wording and the number of words."""

    def rank(evidence: Column, priority: Column) -> Column:
        high = (priority >= bank.HIGH_PRIORITY) | _has_phrase(evidence, bank.STRONG)
        if bank.HIGH_WORDS:
            high = high | (_words(evidence) >= bank.HIGH_WORDS)
        return F.when(high, 3).when((priority >= bank.MEDIUM_PRIORITY) | (_words(evidence) >= 2), 2).otherwise(1)

    return rank


def _extract(df: DataFrame, text: str, ontology: dict, rank, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best evidence per report and key: highest confidence, then longest, then earliest."""
    entries, priorities = [], []
    for family, items in ontology.items():
        for key, (label, patterns, *priority) in items.items():
            entries.append(_hit(family, key, label, patterns))
            priorities += [F.lit(f"{family}.{key}"), F.lit(priority[0] if priority else 0)]
    rows = offset_sentences(df, text, keep).withColumn("_h", m.staged(F.filter(F.array(*entries), lambda x: x.place.isNotNull())))
    hits = rows.select("report_id", *keep, "start", F.explode("_h").alias("h"))
    priority = F.element_at(F.create_map(*priorities), F.concat_ws(".", "h.family", "h.ontology_key"))
    spans = hits.select(
        "report_id", *keep, "h.family", "h.ontology_key", "h.label", F.col("h.place.evidence").alias("evidence"),
        (F.col("start") + F.col("h.place.at") - 1).alias("start"), rank(F.col("h.place.evidence"), priority).alias("rank"),
    )
    if keep:
        spans = spans.where(~F.array_contains(keep[0], F.concat_ws(".", "family", "ontology_key")))
    order = F.struct("rank", F.length("evidence").alias("n"), (-F.col("start")).alias("s"))
    best = spans.groupBy("report_id", "family", "ontology_key", "label").agg(F.max_by(F.struct("evidence", "start", "rank"), order).alias("b"))
    return best.select(
        "report_id", "family", "ontology_key", "label", "b.evidence", "b.start", (F.col("b.start") + F.length("b.evidence")).alias("end"),
        F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("b.rank")).alias("confidence"),
    )


def extract_v01(df: DataFrame, text: str = "description") -> DataFrame:
    return _extract(df, text, v01.ONTOLOGY, _lexical_rank)


def extract_v02(df: DataFrame, text: str = "description") -> DataFrame:
    """Contextual patterns whose rule priority drives the confidence."""
    return _extract(df, text, v02.ONTOLOGY, _priority_rank(v02))


def guard_rails(text: Column) -> Column:
    """Names 'family.key' that the whole narrative rules out."""
    low = F.lower(text)
    out = []
    for (family, key), phrases in v03.DROP_IF.items():
        out.append(F.when(_has_phrase(text, phrases), f"{family}.{key}"))
    for (family, key), pattern in v03.DROP_UNLESS.items():
        found = text.rlike(m.any_case(pattern))
        guard = m.may_hit(low, pattern)
        out.append(F.when(~(found if guard is None else guard & found), f"{family}.{key}"))
    return F.array_compact(F.array(*out))


def extract_v03(df: DataFrame, text: str = "description") -> DataFrame:
    """Stricter patterns, and guard rails that drop keys the narrative as a whole rules out."""
    railed = df.withColumn("_out", m.staged(guard_rails(F.coalesce(F.col(text), F.lit("")))))
    return _extract(railed, text, v03.ONTOLOGY, _priority_rank(v03), ("_out",))


def ontology_summary(best: DataFrame) -> DataFrame:
    """Counts and signals per report with at least one hit."""
    family, key = F.col("family"), F.col("ontology_key")
    names = {"hazards": "hazard", "exposures": "exposure", "consequences": "consequence", "barriers": "barrier", "activities": "activity"}
    return best.groupBy("report_id").agg(
        *[F.count_if(family == f).alias(f"{n}_count") for f, n in names.items()],
        F.count_if((family == "hazards") & key.isin(v01.HIGH_RISK)).alias("high_risk_hazard_count"),
        F.count_if((family == "exposures") & key.isin(v01.DIRECT)).alias("direct_exposure_count"),
        F.count_if((family == "consequences") & key.isin(v01.SEVERE)).alias("severe_consequence_signal_count"),
        F.bool_or((family == "consequences") & (key == "fatality")).alias("has_fatality_wording"),
        F.bool_or((family == "exposures") & key.isin(v01.DIRECT)).alias("has_direct_exposure_signal"),
        F.bool_or(family == "barriers").alias("has_barrier_signal"),
    )
