"""Evidence tagging and pathway features: narrow projections over (report_id, description)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.banks import evidence_v13, evidence_v14, evidence_v15, pathway_features
from hazardloom.functions import matching as m
from hazardloom.functions.text import norm

# The reasons of a context status.
CONTEXT_REASONS = {
    "against": "Narrative explicitly states that personnel were not affected or at risk.",
    "severe": "Mechanism evidence is present together with explicit severe-consequence context.",
    "minor": "Exposure/mechanism is explicit, but available consequence context is localized/minor; SIF sufficiency is not established.",
    "pathway": "Explicit human exposure and mechanism evidence are present; severity/energy context still requires HSSE review.",
    "no_pathway": "Hazard and exposure are present, but a mechanism-specific pathway is not explicit.",
    "hazard": "Hazard is present but human exposure/pathway context is incomplete.",
    "exposure": "Exposure signal is present but hazard/pathway context is incomplete.",
    "nothing": "No sufficient narrative safety context detected by the evidence rules.",
}


def _pathway_hits(text: Column, bank, hazards: Column, exposures: Column, seen: Column) -> Column:
    """Pathways whose mechanism hits and one of whose hazards is present; a pathway that
    shares an exposure's patterns takes over that exposure's evidence."""
    entries = []
    for name in sorted(bank.PATHWAYS):
        source, compatible = bank.PATHWAYS[name]
        evidence = m.evidence_of(exposures, source) if isinstance(source, str) else m.first_hit(text, source, seen)
        entries.append((name, m.has_any_name(hazards, compatible), evidence))
    return m.gated(entries)


def _found(hits: Column) -> Column:
    return F.size(hits) > 0


def _tag(df: DataFrame, bank, text: str, extra: dict) -> DataFrame:
    """Three staged projections: text, category hits, gated pathways. Staging keeps each regex single."""
    hits = {"_hazards": bank.HAZARDS, "_exposures": bank.EXPOSURES, "_context": bank.CONTEXT, **extra}
    own = [source for source, _ in bank.PATHWAYS.values() if not isinstance(source, str)]
    needed = [*m.bank_patterns(*hits.values()), *[p for patterns in own for p in patterns]]
    return (
        df.withColumn("_text", m.staged(norm(F.col(text))))
        .withColumn("_seen", m.staged(m.begun_words(F.col("_text"), needed)))
        .withColumns({name: m.staged(m.categories(F.col("_text"), b, F.col("_seen"))) for name, b in hits.items()})
        .withColumn("_pathways", m.staged(_pathway_hits(F.col("_text"), bank, F.col("_hazards"), F.col("_exposures"), F.col("_seen"))))
        .withColumn("_exposures", F.filter("_exposures", lambda x: x.category != bank.NOT_AN_EXPOSURE))
    )


def _signals(df: DataFrame) -> DataFrame:
    hazard, exposure, pathway = (_found(F.col(c)).cast("int") for c in ("_hazards", "_exposures", "_pathways"))
    return (
        df.withColumns({"hazard_signal": hazard, "exposure_signal": exposure, "pathway_signal": pathway})
        .withColumn("pathway_signal_strength", F.expr("hazard_signal + exposure_signal + pathway_signal"))
        .withColumn("complete_pathway", (F.col("pathway_signal_strength") == 3).cast("int"))
    )


def strength_word(strength: Column) -> Column:
    return F.when(strength == 3, "SUPPORTED").when(strength == 2, "PARTIAL").when(strength == 1, "WEAK").otherwise("NONE")


def _rendered(*families: str) -> dict[str, Column]:
    out = {}
    for family in families:
        out[family] = m.render_names(F.col("_" + family))
        out[family[:-1] + "_evidence"] = m.render_evidence(F.col("_" + family))
    return out


def _context_status() -> tuple[Column, Column]:
    """Ordered decision; the first rule that holds gives status and reason."""
    hazard, exposure, pathway = _found(F.col("_hazards")), _found(F.col("_exposures")), _found(F.col("_pathways"))
    minor, severe = _found(F.col("_minor")), _found(F.col("_severe"))
    against = F.array_contains(m.names(F.col("_context")), "no_person_affected")
    rules = [
        (against, "CONTEXT_AGAINST_SIF", "against"),
        (severe & pathway, "SUFFICIENT_CONTEXT", "severe"),
        (pathway & minor & ~severe, "CONTEXT_LIMITED", "minor"),
        (pathway & exposure, "SUFFICIENT_CONTEXT", "pathway"),
        (hazard & exposure, "CONTEXT_LIMITED", "no_pathway"),
        (hazard, "UNKNOWN", "hazard"),
        (exposure, "UNKNOWN", "exposure"),
    ]
    status = F.lit("UNKNOWN")
    reason = F.lit(CONTEXT_REASONS["nothing"])
    for condition, word, key in reversed(rules):
        status = F.when(condition, word).otherwise(status)
        reason = F.when(condition, CONTEXT_REASONS[key]).otherwise(reason)
    return status, reason


def _drop_working(df: DataFrame) -> DataFrame:
    return df.select([c for c in df.columns if not c.startswith("_")])


def evidence_v15_tags(df: DataFrame, text: str = "description") -> DataFrame:
    """Current evidence tagging: rendered names and evidence, signals, context status, assessment."""
    tagged = _signals(
        _tag(df, evidence_v15, text, {"_minor": evidence_v15.MINOR_CONTEXT, "_severe": evidence_v15.SEVERE_CONTEXT})
    )
    status, reason = _context_status()
    strength = F.col("pathway_signal_strength")
    out = tagged.withColumns(
        {
            **_rendered("hazards", "exposures", "pathways"),
            "minor_context": m.render_evidence(F.col("_minor")),
            "severe_context": m.render_evidence(F.col("_severe")),
            "context_flags": m.render_names(F.col("_context")),
            "sif_context_status": status,
            "sif_context_reason": reason,
        }
    ).withColumn(
        "pathway_assessment",
        # strength 3 against the context is neither SUPPORTED nor one of the weaker words
        F.when((strength == 3) & (F.col("sif_context_status") == "CONTEXT_AGAINST_SIF"), "NONE").otherwise(
            strength_word(strength)
        ),
    )
    return _drop_working(out)


def _older_evidence(df: DataFrame, bank, text: str, flags: str) -> DataFrame:
    tagged = _signals(_tag(df, bank, text, {}))
    against = F.array_contains(m.names(F.col("_context")), "no_person_affected")
    strength = F.col("pathway_signal_strength")
    out = tagged.withColumns(
        {
            **_rendered("hazards", "exposures", "pathways"),
            flags: m.render_names(F.col("_context")),
            "pathway_assessment": F.when(against & (strength >= 2), "WEAK").otherwise(strength_word(strength)),
        }
    )
    return _drop_working(out)


def evidence_v14_tags(df: DataFrame, text: str = "description") -> DataFrame:
    return _older_evidence(df, evidence_v14, text, "context_flags")


def evidence_v13_tags(df: DataFrame, text: str = "description") -> DataFrame:
    return _older_evidence(df, evidence_v13, text, "safe_context_flags")


def gated_pathways(df: DataFrame, bank, text: str = "description") -> DataFrame:
    """Pathway evidence with any bank of the same shape; water or mud suppresses a chemical
    release unless a chemical is named (a bank whose gate lets it through needs this)."""
    tagged = _tag(df, bank, text, {})
    wet = F.array_contains(m.names(F.col("_context")), "water_mud")
    named = m.has_any_name(F.col("_hazards"), ["chemical"]) | m.has_any_name(F.col("_exposures"), ["chemical_exposure"])
    kept = F.filter("_pathways", lambda x: ~(wet & ~named & (x.category == "chemical_release_exposure")))
    return _drop_working(
        tagged.withColumn("_pathways", kept).withColumns(
            {**_rendered("pathways"), "pathway_count": F.size(F.col("_pathways"))}
        )
    )


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def pathway_feature_names() -> list[str]:
    b = pathway_features
    return (
        [f"path_hazard_{k}" for k in b.HAZARDS]
        + [f"path_exposure_{k}" for k in b.EXPOSURES]
        + [f"pathway_{k}" for k in b.PATHWAYS]
        + ["path_hazard_count", "path_exposure_count", "pathway_count"]
        + ["path_hazard_exposure", "path_hazard_pathway", "path_exposure_pathway", "path_complete"]
        + [*b.COMPLETE, "path_line_fire"]
    )


def _feature_totals(df: DataFrame, hazards, exposures, pathways, complete, line_fire: Column) -> DataFrame:
    counted = df.withColumns(
        {
            "path_hazard_count": _sum([F.col(f"path_hazard_{k}") for k in hazards]),
            "path_exposure_count": _sum([F.col(f"path_exposure_{k}") for k in exposures]),
            "pathway_count": _sum([F.col(f"pathway_{k}") for k in pathways]),
        }
    )
    h, e, p = (F.col(c) > 0 for c in ("path_hazard_count", "path_exposure_count", "pathway_count"))
    combos = {
        "path_hazard_exposure": h & e,
        "path_hazard_pathway": h & p,
        "path_exposure_pathway": e & p,
        "path_complete": h & e & p,
        "path_line_fire": line_fire,
    }
    for name, (hazard, exposure, pathway) in complete.items():
        combos[name] = (
            (F.col(f"path_hazard_{hazard}") == 1)
            & (F.col(f"path_exposure_{exposure}") == 1)
            & (F.col(f"pathway_{pathway}") == 1)
        )
    return counted.withColumns({k: v.cast("int") for k, v in combos.items()})


def pathway_feature_columns(df: DataFrame, text: str = "description") -> DataFrame:
    """The 38 0/1 and count features of the model, in a fixed order, beside the input columns."""
    b = pathway_features
    t, seen = F.col("_text"), F.col("_seen")
    flags = {f"path_hazard_{k}": m.any_of(t, p, seen) for k, p in b.HAZARDS.items()}
    flags |= {f"path_exposure_{k}": m.any_of(t, p, seen) for k, p in b.EXPOSURES.items()}
    flags |= {f"pathway_{k}": m.any_of(t, p, seen) for k, p in b.PATHWAYS.items()}
    flags = {k: m.staged(v.cast("int")) for k, v in flags.items()}
    line_fire = (F.col("path_exposure_line_of_fire") == 1) & (
        (F.col("pathway_struck_by_projectile") == 1)
        | (F.col("path_hazard_vehicle") == 1)
        | (F.col("path_hazard_dropped_object") == 1)
    )
    words = m.staged(m.begun_words(t, m.bank_patterns(b.HAZARDS, b.EXPOSURES, b.PATHWAYS)))
    tagged = df.withColumn("_text", m.staged(norm(F.col(text)))).withColumn("_seen", words).withColumns(flags)
    out = _feature_totals(tagged, b.HAZARDS, b.EXPOSURES, b.PATHWAYS, b.COMPLETE, line_fire)
    return out.select(*df.columns, *pathway_feature_names())


def training_evidence(df: DataFrame, text: str = "description") -> DataFrame:
    """Names, strength and assessment from the feature bank."""
    features = pathway_feature_columns(df, text)

    def listed(prefix: str, categories) -> Column:
        flags = F.array(*[F.when(F.col(prefix + k) == 1, k) for k in sorted(categories)])
        return F.array_join(F.array_compact(flags), " | ")

    b = pathway_features
    strength = _sum([(F.col(c) > 0).cast("int") for c in ("path_hazard_count", "path_exposure_count", "pathway_count")])
    return features.select(
        *df.columns,
        listed("path_hazard_", b.HAZARDS).alias("hazards"),
        listed("path_exposure_", b.EXPOSURES).alias("exposures"),
        listed("pathway_", b.PATHWAYS).alias("pathways"),
        strength.alias("pathway_signal_strength"),
        strength_word(strength).alias("pathway_assessment"),
    )


def reconstructed_features(tags: DataFrame) -> DataFrame:
    """The 38 feature names filled from evidence labels; names without a label are zero."""
    hazards = list(evidence_v15.HAZARDS)
    exposures = [e for e in evidence_v15.EXPOSURES if e != evidence_v15.NOT_AN_EXPOSURE]
    pathways = list(evidence_v15.PATHWAYS)

    def has(column: str, name: str) -> Column:
        return F.array_contains(F.split(F.col(column), r" \| "), name).cast("int")

    flags = {f"path_hazard_{k}": has("hazards", k) for k in hazards}
    flags |= {f"path_exposure_{k}": has("exposures", k) for k in exposures}
    flags |= {f"pathway_{k}": has("pathways", k) for k in pathways}
    complete = {
        "path_electrical_complete": ("electrical", "electrical_exposure", "electrical_contact"),
        "path_chemical_complete": ("chemical", "chemical_exposure", "chemical_release_exposure"),
        "path_fall_complete": ("fall_height", "fall_exposure", "fall_from_height"),
        "path_vehicle_complete": ("vehicle", "vehicle_exposure", "vehicle_person_collision"),
        "path_caught_complete": ("mechanical", "caught_between_exposure", "caught_crush"),
    }
    line_fire = (F.col("path_exposure_line_of_fire") == 1) & (
        (F.col("pathway_struck_by_projectile") == 1)
        | (F.col("path_hazard_vehicle") == 1)
        | (F.col("path_hazard_stored_projectile") == 1)
    )
    filled = _feature_totals(tags.withColumns(flags), hazards, exposures, pathways, complete, line_fire)
    wanted = [F.col(n) if n in filled.columns else F.lit(0).alias(n) for n in pathway_feature_names()]
    return filled.select("report_id", *wanted)
