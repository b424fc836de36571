"""Structured features v0.1: label one-hots, cues, magnitudes and interactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.banks import structured_features as b
from hazardloom.banks.precursors import BODY_PARTS
from hazardloom.functions import matching as m
from hazardloom.functions import text as tx

COUNTS = ["hazard_count", "exposure_count", "actual_consequence_count", "potential_consequence_count", "barrier_count", "activity_count"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def structured_features(flat: DataFrame, text: str = "description") -> DataFrame:
    """Feature table over a flat v0.6 extraction that still carries its narrative."""
    rows = flat.withColumns(
        {
            "_h": m.staged(tx.split_list(F.col("hazards"))), "_e": m.staged(tx.split_list(F.col("exposures"))),
            "_a": m.staged(tx.split_list(F.col("actual_consequences"))), "_p": m.staged(tx.split_list(F.col("potential_consequences"))),
            "_b": m.staged(tx.split_list(F.lower("observed_barriers"))), "_t": m.staged(tx.norm(F.col(text))),
        }
    )
    has = F.array_contains
    flags: dict[str, Column] = {}
    for prefix, column, table in (("hazard_", "_h", b.HAZARDS), ("exposure_", "_e", b.EXPOSURES), ("actual_", "_a", b.ACTUAL), ("potential_", "_p", b.POTENTIAL)):
        flags |= {prefix + k: has(F.col(column), label) for k, label in table.items()}
    for k, label in b.BARRIERS.items():
        for suffix, status in (("present", "[present]"), ("failed", "[failed_or_absent]")):
            flags[f"barrier_{k}_{suffix}"] = _barrier(label.lower(), status)
    low = F.col("_t")
    flags |= {k: m.any_of(low, patterns) for k, patterns in b.CUES.items()}
    flags |= {k: _any([F.contains(low, F.lit(x)) for x in terms]) for k, terms in b.TERMS.items()}
    flags |= {f"body_{x}_in_narrative": m.hits(low, rf"\b{x}\b") for x in BODY_PARTS}
    flags |= {k: has("_h", h) & _any([has("_e", e) for e in es]) for k, (h, es) in b.WITH_EXPOSURE.items()}
    flags |= {k: (has("_h", x) | has("_e", x)) & has("_p", p) for k, (x, p) in b.WITH_POTENTIAL.items()}
    flags |= {k: has("_h", h) & _any([F.exists("_b", _holds(g.lower())) for g in gaps]) for k, (h, gaps) in b.WITH_GAP.items()}
    numbers = {
        "narrative_chars": F.length(low), "narrative_words": tx.word_count(low),
        "line_of_fire_distance_m": F.greatest(*[_near(low, p) for p in b.FIRE_LINE]),
        "max_height_m": F.greatest(*[tx.max_number(low, p) for p in b.HEIGHTS]),
        "voltage_max_v": tx.max_number(low, b.VOLTS), "current_max_a": tx.max_number(low, b.AMPS),
    }
    rows = rows.withColumns({**{k: m.staged(v.cast("int")) for k, v in flags.items()}, **{k: m.staged(v) for k, v in numbers.items()}})
    late = {
        "low_height_event": F.coalesce(F.col("max_height_m") < 1.0, F.lit(False)),
        "significant_height_event": F.coalesce(F.col("max_height_m") >= 2.0, F.lit(False)),
        "high_voltage_signal": F.coalesce(F.col("voltage_max_v") >= 50, F.lit(False)),
    }
    rows = rows.withColumns({k: v.cast("int") for k, v in late.items()})
    return rows.select("report_id", *flags, *numbers, *late, *COUNTS)


def _barrier(label: str, status: str) -> Column:
    return F.exists("_b", lambda x: x.startswith(label) & F.contains(x, F.lit(status)))


def _holds(part: str):
    return lambda x: F.contains(x, F.lit(part))


def _near(low: Column, cue: str) -> Column:
    return F.when(m.may_hit(low, cue), m.max_number_near(low, cue))
