"""Registered queries: extraction jobs, label rules and reasoning scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.banks import extraction_v04 as v04
from hazardloom.banks import extraction_v06 as v06
from hazardloom.banks import rules as rule_bank
from hazardloom.functions import matching as m
from hazardloom.operators import extraction as x
from hazardloom.operators import reasoning
from hazardloom.operators.rules import label_candidates
from hazardloom.plans.tables import reports


def _narrow(spark, sf):
    return reports(spark, sf).select("report_id", "description")


def extract_v04(spark, sf):
    return x.extract_v04(_narrow(spark, sf)).drop("description")


SIGNALS = [
    "has_fatality_evidence", "has_caught_between_evidence", "has_direct_exposure_evidence",
    "has_severe_consequence_signal", "has_high_energy_signal", "has_barrier_failure_signal",
]


def derived_signals(spark, sf):
    return x.extract_v04(_narrow(spark, sf)).select("report_id", *SIGNALS, "sif_precursor_signal_score")


def extract_v05(spark, sf):
    return x.extract_v05(_narrow(spark, sf))


def flat_v06(spark, sf):
    return x.extract_v06(_narrow(spark, sf))


def activity_metadata(spark, sf):
    return x.activity_metadata(_narrow(spark, sf))


def collect_hits(spark, sf):
    """Capped hits of the hazard bank in long form."""
    rows = x._staged_text(_narrow(spark, sf), "description", v04.HAZARDS)
    found = rows.withColumn("_h", m.staged(m.collect_hits(F.col("_t"), F.col("_seen"), v04.HAZARDS, 8)))
    return found.select("report_id", F.posexplode("_h").alias("pos", "hit")).select(
        "report_id", F.col("pos").alias("position"), "hit.label", "hit.evidence"
    )


def dedup_longest(spark, sf):
    rows = x._staged_text(_narrow(spark, sf), "description", v06.HAZARDS)
    hits = m.collect_hits(F.col("_t"), F.col("_seen"), v06.HAZARDS, 20)
    found = rows.withColumn("_h", m.staged(hits)).withColumn(
        "_best", m.staged(m.longest_per_label(F.col("_h"), list(dict(v06.HAZARDS))))
    )
    return found.select("report_id", F.explode("_best").alias("hit")).select("report_id", "hit.label", "hit.evidence")


def barrier_negation(spark, sf):
    rows = x._staged_text(_narrow(spark, sf), "description", v04.FAILURES, v04.BARRIERS).withColumn("_b", m.staged(x._barriers_v04()))
    return rows.select("report_id", F.explode("_b").alias("b")).select("report_id", "b.label", "b.status", "b.evidence")


BURN = r"\b(?:burn(?:ed)?|scald(?:ed)?|redness)\b"


def context_guard(spark, sf):
    """Burn wording kept only where steam, heat or a severe degree stands within 40 characters."""
    rows = x._staged_text(_narrow(spark, sf), "description", [("Burn", BURN)])
    hits = m.collect_hits(F.col("_t"), F.col("_seen"), [("Burn", BURN)], 10)
    kept = x.guard_by_context(F.col("_h"), F.col("_t"), "Burn", BURN, 40, lambda c: c.rlike("steam|hot|severe"))
    found = rows.withColumn("_h", m.staged(hits)).withColumn("_k", m.staged(kept))
    return found.select("report_id", F.explode("_k").alias("k")).select("report_id", "k.label", "k.evidence")


def potential_consequences(spark, sf):
    rows = x.potential_consequences(_narrow(spark, sf))
    return rows.select("report_id", F.explode("_potential").alias("p")).select("report_id", "p.label", "p.evidence")


def _labels(rules, needs):
    def run(spark, sf):
        rows = label_candidates(reasoning.prepare(flat_v06(spark, sf)), rules, needs)
        return rows.select("report_id", F.posexplode("label_candidates").alias("pos", "c")).select(
            "report_id", (F.col("pos") + 1).alias("place"), "c.rule", "c.score"
        )

    return run


def reasoning_v01(spark, sf):
    return reasoning.reasoning_v01(flat_v06(spark, sf))


def reasoning_v02(spark, sf):
    return reasoning.reasoning_v02(flat_v06(spark, sf))


def mechanism_signals(spark, sf):
    rows = reasoning.mechanism_signals(reasoning.prepare(flat_v06(spark, sf)))
    return rows.select("report_id", *[F.col(c).cast("int").alias(c) for c in reasoning.SIGNAL_NAMES])


def barrier_status_parse(spark, sf):
    present, failed = reasoning.barrier_status(F.col("observed_barriers"))
    return flat_v06(spark, sf).select(
        "report_id", F.array_join(present, "; ").alias("barriers_present"), F.array_join(failed, "; ").alias("barriers_failed")
    )


def reasoning_summary(spark, sf):
    rows = reasoning.reasoning_v02(flat_v06(spark, sf))
    return rows.groupBy("sif_precursor_band").agg(
        F.count(F.lit(1)).alias("reports"), F.round(F.avg("sif_precursor_score"), 9).alias("mean_score"),
        F.sum(F.size(F.filter(F.split("lsr_candidates", "; "), lambda v: v != ""))).cast("bigint").alias("rule_candidates"),
    )


def extraction_coverage(spark, sf):
    rows = x.extract_v04(_narrow(spark, sf))
    families = {"hazards": "hazard", "exposures": "exposure", "consequences": "consequence", "barriers": "barrier", "activities": "activity"}
    long = rows.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("family"), (F.col(k) != "").alias("filled"), F.col(f"{v}_count").alias("n"))
                    for k, v in families.items()
                ]
            )
        ).alias("r")
    )
    return long.groupBy(F.col("r.family").alias("family")).agg(
        F.round(100.0 * F.avg(F.col("r.filled").cast("int")), 2).alias("coverage_percent"),
        F.round(F.avg("r.n"), 3).alias("mean_count"),
    )


QUERIES = {
    "extract_v04": extract_v04,
    "derived_signals": derived_signals,
    "extract_v05": extract_v05,
    "extract_v06": flat_v06,
    "activity_metadata": activity_metadata,
    "collect_hits": collect_hits,
    "dedup_longest_evidence": dedup_longest,
    "barrier_negation": barrier_negation,
    "context_guard": context_guard,
    "potential_consequences": potential_consequences,
    "lsr_labels_v01": _labels(rule_bank.LABELS_V01, False),
    "lsr_labels_v02": _labels(rule_bank.LABELS_V02, True),
    "reasoning_v01": reasoning_v01,
    "reasoning_v02": reasoning_v02,
    "mechanism_signals": mechanism_signals,
    "barrier_status_parse": barrier_status_parse,
    "reasoning_summary": reasoning_summary,
    "extraction_coverage": extraction_coverage,
}
