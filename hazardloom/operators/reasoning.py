"""Reasoning scores over a flat extraction table: mechanism signals, gates, bands, label rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.banks import rules as bank
from hazardloom.functions.matching import staged
from hazardloom.functions.text import split_list
from hazardloom.operators.rules import label_candidates

EVIDENCE_COLUMNS = [
    "hazard_evidence", "exposure_evidence", "actual_consequence_evidence", "potential_consequence_evidence",
    "barrier_evidence", "activity_evidence",
]
LISTS = {
    "_hazards": "hazards", "_exposures": "exposures", "_actual": "actual_consequences",
    "_potential": "potential_consequences", "_activities": "activities",
}
STATUS_ITEM = r"(?i)^(.+?)\s+\[(present|failed_or_absent)\]$"

# Cue words of the mechanism signals.
CUES = {
    "confined_space": ["confined space", "inside the chute", "discharge chute", "restricted space"],
    "seat_belt_present": ["seat belt", "safety belt"],
    "strong_vehicle_event": ["rollover", "roll over", "ejection", "collision", "crash", "vehicle turns", "excavated"],
    "low_fall_06m": ["0.60", "0.6 m", "0.60 cm"],
    "medium_fall": ["2.5 m", "2.98m", "2.98 m", "3 m", "3m"],
    "chemical_face_eye": ["face", "eye", "eyes", "upper limb", "respiratory", "inhalation"],
    "chemical_concentration_evidence": ["concentration", "high concentration", "large volume", "significant release"],
    "vehicle_occupant_protection": ["seat belt", "safety belt"],
}
ENTANGLED = ["hooked", "pulled", "caught", "propeller", "fan", "rotating"]


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _overlap(items: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(items, F.array(*[F.lit(x) for x in wanted]))


def barrier_status(c: Column) -> tuple[Column, Column]:
    """Sorted distinct names of present and of failed barriers; an item without status is present."""
    items = split_list(c)
    status = lambda x: F.lower(F.regexp_extract(x, STATUS_ITEM, 2))
    name = lambda x: F.when(status(x) != "", F.trim(F.regexp_extract(x, STATUS_ITEM, 1))).otherwise(x)
    present = F.transform(F.filter(items, lambda x: status(x) != "failed_or_absent"), name)
    failed = F.transform(F.filter(items, lambda x: status(x) == "failed_or_absent"), name)
    return F.array_sort(F.array_distinct(present)), F.array_sort(F.array_distinct(failed))


def prepare(flat: DataFrame) -> DataFrame:
    """Adds label arrays, the joined evidence text and barrier lists used by all scores."""
    evidence = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in EVIDENCE_COLUMNS])
    present, failed = barrier_status(F.col("observed_barriers"))
    staged_lists = {k: staged(split_list(F.col(v))) for k, v in LISTS.items()}
    return flat.withColumns(
        {**staged_lists, "evidence_text": staged(evidence), "_present": staged(present), "_failed": staged(failed)}
    )


def mechanism_signals(prepared: DataFrame) -> DataFrame:
    """Adds 22 boolean mechanism signals."""
    h, e, a = F.col("_hazards"), F.col("_exposures"), F.col("_actual")
    has = F.array_contains
    low = F.col("_low")
    line = has(e, "Line-of-fire exposure")
    signals = {
        "electrical": has(h, "Electrical energy"),
        "chemical": has(h, "Chemical energy / hazardous substance"),
        "thermal": has(h, "Thermal energy"),
        "vehicle": has(h, "Vehicle / mobile equipment energy"),
        "fall_height": has(h, "Fall-from-height energy"),
        "caught_between": has(h, "Caught-between / pinch energy") | has(e, "Caught-between / pinch exposure"),
        "projectile": has(h, "Falling object / dropped object energy") | line,
        "mechanical": has(h, "Mechanical / moving equipment energy"),
        "actual_severe": _overlap(a, bank.SEVERE_ACTUAL),
        "potential_severe": F.size("_potential") > 0,
        "direct_exposure": F.size("_exposures") > 0,
        "line_of_fire": line,
        "work_at_height": has(F.col("_activities"), "Working at height"),
        "barrier_failure": F.contains(F.col("observed_barriers"), F.lit("[failed_or_absent]")),
        **{name: _contains_any(low, words) for name, words in CUES.items()},
    }
    lowered = staged(F.lower(F.regexp_replace("evidence_text", r"(?U)\s+", " ")))
    return prepared.withColumn("_low", lowered).withColumns({k: staged(v) for k, v in signals.items()})


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _sum(parts: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in parts])


def _reasons(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, r) for c, r in pairs])), "; ")


def _only_mild(actual: Column) -> Column:
    return (F.size(actual) > 0) & F.forall(actual, lambda x: x.isin(bank.MILD_ACTUAL))


def _lists() -> list[Column]:
    return [
        F.array_join("_present", "; ").alias("barriers_present"),
        F.array_join("_failed", "; ").alias("barriers_failed"),
        F.array_join(F.transform("label_candidates", lambda x: x.rule), "; ").alias("lsr_candidates"),
    ]


def reasoning_v01(flat: DataFrame) -> DataFrame:
    """Additive score with bands at .70 and .45."""
    rows = label_candidates(prepare(flat), bank.LABELS_V01, line_of_fire_needs_exposure=False)
    h, e, a, p = (F.col(c) for c in ("_hazards", "_exposures", "_actual", "_potential"))
    energetic, severe = _overlap(h, bank.HIGH_ENERGY), _overlap(a, bank.SEVERE_ACTUAL)
    mild = _only_mild(a) & ~energetic & (F.size(p) == 0)
    parts = [
        (energetic, 0.25), (F.size(e) > 0, 0.20), (severe, 0.35), (F.size(p) > 0, 0.25),
        (F.size("_failed") > 0, 0.15), (mild, -0.20),
    ]
    words = [
        "high-energy hazard", "human exposure signal", "severe/critical actual consequence",
        "credible severe potential pathway", "barrier gap/failure signal", "low-energy-only observed event",
    ]
    rows = rows.withColumn("_score", staged(F.round(_clamped(_sum(parts)), 9)))
    band = F.when(F.col("_score") >= 0.70, "HIGH").when(F.col("_score") >= 0.45, "MEDIUM").otherwise("LOW")
    trigger = (
        F.when(F.size(p) > 0, F.array_join(F.slice(p, 1, 2), " + "))
        .when(energetic, "High-energy hazard with exposure")
        .when(F.size(a) > 0, F.get(a, F.lit(0)))
        .otherwise("No strong SIF precursor signal")
    )
    return rows.select(
        "report_id", band.alias("sif_precursor_band"), F.round("_score", 3).alias("sif_precursor_score"),
        trigger.alias("primary_trigger"), _reasons([(c, w) for (c, _), w in zip(parts, words)]).alias("reason_codes"),
        *_lists(),
    )


def reasoning_v02(flat: DataFrame) -> DataFrame:
    """Score with mechanism-specific gates on potential severity and a low-energy cap."""
    rows = label_candidates(
        mechanism_signals(prepare(flat)), bank.LABELS_V02, line_of_fire_needs_exposure=True
    )
    s = lambda name: F.col(name)
    direct = s("direct_exposure")
    entangled = F.lower(F.concat_ws(" ", F.col("hazard_evidence"), F.col("exposure_evidence")))
    gate = (
        F.when(~s("potential_severe"), False)
        .when(s("electrical"), direct)
        .when(s("caught_between"), True)
        .when(s("fall_height"), s("medium_fall") & direct)
        .when(s("vehicle"), s("strong_vehicle_event") & direct)
        .when(s("chemical"), s("chemical_face_eye") & (s("chemical_concentration_evidence") | s("line_of_fire")))
        .when(s("thermal") | s("projectile"), direct)
        .when(s("mechanical"), _contains_any(entangled, ENTANGLED) & direct)
        .otherwise(False)
    )
    rows = rows.withColumn("_open", staged(gate))
    opened = F.col("_open")
    specific = s("caught_between") | s("line_of_fire") | s("electrical") | s("vehicle")
    energetic = _overlap(F.col("_hazards"), bank.HIGH_ENERGY_V02)
    generic = ~specific & (F.size("_exposures") > 0)
    failed, present = F.size("_failed") > 0, F.size("_present") > 0
    shielded = present & ~s("actual_severe")
    low_fall = s("low_fall_06m") & ~s("actual_severe")
    mild = _only_mild(F.col("_actual")) & ~s("actual_severe") & ~opened
    total = _sum(
        [
            (energetic, 0.20), (specific, 0.20), (generic, 0.06), (s("actual_severe"), 0.35), (opened, 0.25),
            (failed, 0.10), (shielded, -0.03),
        ]
    )
    score = _clamped(F.when(low_fall | mild, F.least(total, F.lit(0.30))).otherwise(total))
    reasons = [
        (energetic, "high-energy mechanism"),
        (specific, "specific exposure pathway"),
        (generic, "generic exposure signal"),
        (s("actual_severe"), "severe actual consequence"),
        (opened, "credible severe potential pathway"),
        (~opened & s("potential_severe"), "potential severity signal not sufficiently grounded"),
        (failed, "explicit barrier failure/absence"),
        (shielded, "protective control explicitly present"),
        (low_fall, "0.6 m fall is low-energy without secondary severe mechanism"),
        (mild, "observed outcome is low severity without credible escalation gate"),
    ]
    rows = rows.withColumn("_score", staged(F.round(score, 9)))
    forced = s("actual_severe") & (s("electrical") | s("caught_between") | s("fall_height") | s("vehicle"))
    band = F.when(forced | (F.col("_score") >= 0.60), "HIGH").when(F.col("_score") >= 0.35, "MEDIUM").otherwise("LOW")
    trigger = F.coalesce(
        F.when(opened, F.get("_potential", F.lit(0))), F.get("_actual", F.lit(0)), F.get("_hazards", F.lit(0)),
        F.lit("No strong SIF precursor signal"),
    )
    gates = F.when(opened, "potential severity gate passed").when(s("potential_severe"), "potential severity gate failed")
    return rows.select(
        "report_id", band.alias("sif_precursor_band"), F.round("_score", 3).alias("sif_precursor_score"),
        trigger.alias("primary_trigger"), _reasons(reasons).alias("reason_codes"),
        F.coalesce(gates, F.lit("")).alias("gate_codes"), *_lists(),
    )


SIGNAL_NAMES = [
    "electrical", "chemical", "thermal", "vehicle", "fall_height", "caught_between", "projectile", "mechanical",
    "actual_severe", "potential_severe", "direct_exposure", "line_of_fire", "work_at_height", "barrier_failure", *CUES,
]
