"""Label/evidence extraction jobs v0.4 to v0.6 and the activity table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.banks import extraction_v04 as v04
from hazardloom.banks import extraction_v05 as v05
from hazardloom.banks import extraction_v06 as v06
from hazardloom.functions import matching as m
from hazardloom.functions.text import around, bound, join_unique, squeeze


def _staged_text(df: DataFrame, text: str, *banks) -> DataFrame:
    """Adds the squeezed text, its lower-cased form and the words seen in it that the banks' patterns need."""
    staged = df.withColumn("_t", m.staged(squeeze(F.col(text)))).withColumn("_low", m.staged(F.lower("_t")))
    return staged.withColumn("_seen", m.staged(m.begun_words(_low(), m.bank_patterns(*banks))))


def _t() -> Column:
    return F.col("_t")


def _low() -> Column:
    return F.col("_low")


def _seen() -> Column:
    return F.col("_seen")


def labels_of(items: Column) -> Column:
    return F.transform(items, lambda x: x.label)


def evidence_of(items: Column) -> Column:
    return F.transform(items, lambda x: x.evidence)


def _has(items: Column, labels: list[str]) -> Column:
    return F.exists(items, lambda x: x.label.isin(labels))


def _item(label: str, evidence: Column, **more: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), evidence.alias("evidence"), *[v.alias(k) for k, v in more.items()])


def _some(*items: Column) -> Column:
    """Array of those items whose evidence exists."""
    return F.filter(F.array(*items), lambda x: x.evidence.isNotNull())


def guard_by_context(items: Column, text: Column, label: str, pattern: str, reach: int, accept) -> Column:
    """Drop items of a label whose surrounding text is not accepted; the first place of the same
    evidence in the text gives the context."""
    places = m.located_hits(text, m.any_case(pattern))

    def context(places: Column, evidence: Column) -> Column:
        place = F.get(F.filter(places, lambda y: F.lower(F.trim(y.evidence)) == F.lower(evidence)), F.lit(0))
        return F.lower(around(text, place["at"], F.length(place["evidence"]), reach))

    return bound(places, lambda at: F.filter(items, lambda x: (x.label != label) | accept(context(at, x.evidence))))


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _barriers_v04() -> Column:
    """Explicit gaps first; a mention of another barrier is a gap when a negation stands near it."""
    failed = dict(v04.FAILURES)
    items = []
    for label, pattern in v04.FAILURES:
        items.append(_item(label, squeeze(m.hit_text(_low(), pattern, _seen())), status=F.lit("failed_or_absent")))
    gaps = [F.when(i.evidence != "", i) for i in items]
    for label, pattern in v04.BARRIERS:
        at = F.regexp_instr(_low(), F.lit(m.unicode_word(pattern)))
        evidence = F.regexp_extract(_t(), m.any_case(pattern), 0)
        near = around(_low(), at, F.length(evidence), 70)
        status = F.when(near.rlike(m.unicode_word(v04.NEGATION)), "failed_or_absent").otherwise("present")
        guard = m.may_hit(_seen(), pattern)
        seen = m.hits(_low(), failed[label], _seen()) if label in failed else F.lit(False)
        gaps.append(F.when(guard & (at > 0) & ~seen, _item(label, evidence, status=status)))
    return F.array_compact(F.array(*gaps))


def barrier_text(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(x.label, F.lit(" ["), x.status, F.lit("]")))


def _v04_items(df: DataFrame, text: str) -> DataFrame:
    staged = _staged_text(df, text, v04.HAZARDS, v04.EXPOSURES, v04.CONSEQUENCES, v04.ACTIVITIES, v04.FAILURES, v04.BARRIERS)
    hazards = m.collect_hits(_t(), _seen(), v04.HAZARDS, 8)
    fire = dict(v04.HAZARDS)["Fire / explosion energy"]
    burn = dict(v04.CONSEQUENCES)["Burn / thermal injury"]
    lists = staged.withColumns(
        {
            "_hazards": m.staged(hazards),
            "_exposures": m.staged(m.collect_hits(_t(), _seen(), v04.EXPOSURES, 8)),
            "_consequences": m.staged(m.collect_hits(_t(), _seen(), v04.CONSEQUENCES, 10)),
            "_barriers": m.staged(_barriers_v04()),
            "_activities": m.staged(m.collect_hits(_t(), _seen(), v04.ACTIVITIES, 5)),
        }
    )
    flash = guard_by_context(
        F.col("_hazards"), _t(), "Fire / explosion energy", fire, 75, lambda c: _contains_any(c, v04.FLASH_CONTEXT)
    )
    only_flash = F.exists("_hazards", lambda x: F.lower(x.evidence) == "flash")
    unburnt = F.exists("_consequences", lambda x: F.lower(x.evidence).startswith("scald"))
    heat = guard_by_context(
        F.col("_consequences"), _t(), "Burn / thermal injury", burn, 75, lambda c: c.rlike(v04.HEAT_CONTEXT)
    )
    direct = squeeze(F.regexp_extract(_low(), m.begun(v04.HUMAN + ".{0,80}" + v04.INJURY), 0))
    caught = (
        r"\b(?:caught[- ]between|imprisoned between|crushed between|finger.*?(?:caught|trapped|imprisoned)"
        r"|hand.*?(?:caught|trapped|imprisoned))\b"
    )
    inferred = F.when(
        ~_has(F.col("_exposures"), ["Direct worker exposure"]) & (direct != ""),
        F.array(_item("Direct worker exposure", direct)),
    ).otherwise(F.slice("_exposures", 1, 0))
    squeezed = F.when(
        ~_has(F.col("_exposures"), ["Caught-between / pinch exposure"]) & m.hits(_low(), caught),
        F.array(_item("Caught-between / pinch exposure", F.regexp_extract(_t(), m.any_case(caught), 0))),
    ).otherwise(F.slice("_exposures", 1, 0))
    return lists.withColumns(
        {
            # evidence 'flash' alone, or a scald, is the only evidence whose context decides
            "_hazards": m.staged(
                F.when(
                    only_flash,
                    F.filter(
                        "_hazards",
                        lambda x: (F.lower(x.evidence) != "flash") | F.array_contains(labels_of(flash), "Fire / explosion energy"),
                    ),
                ).otherwise(F.col("_hazards"))
            ),
            "_consequences": m.staged(F.when(unburnt, heat).otherwise(F.col("_consequences"))),
            "_exposures": m.staged(F.concat("_exposures", inferred, squeezed)),
        }
    )


def _signals_v04() -> dict[str, Column]:
    fatal = m.hits(_low(), v04.FATALITY)
    caught = _has(F.col("_exposures"), ["Caught-between / pinch exposure"]) | m.hits(_low(), v04.CAUGHT)
    return {
        "has_fatality_evidence": fatal,
        "has_caught_between_evidence": caught,
        "has_direct_exposure_evidence": _has(F.col("_exposures"), v04.DIRECT_EXPOSURE),
        "has_severe_consequence_signal": _has(F.col("_consequences"), v04.SEVERE),
        "has_high_energy_signal": _has(F.col("_hazards"), v04.HIGH_ENERGY),
        "has_barrier_failure_signal": F.exists("_barriers", lambda x: x.status == "failed_or_absent"),
    }


def extract_v04(df: DataFrame, text: str = "description") -> DataFrame:
    """Flat extraction with derived signals and the capped precursor score."""
    rows = _v04_items(df, text)
    families = {"hazard": "_hazards", "exposure": "_exposures", "consequence": "_consequences", "activity": "_activities"}
    plural = {"hazard": "hazards", "exposure": "exposures", "consequence": "consequences", "activity": "activities"}
    flat = {}
    for name, column in families.items():
        flat[plural[name]] = join_unique(labels_of(F.col(column)))
        flat[f"{name}_evidence"] = join_unique(evidence_of(F.col(column)))
        flat[f"{name}_count"] = F.size(column)
    flat["barriers"] = join_unique(barrier_text(F.col("_barriers")))
    flat["barrier_evidence"] = join_unique(evidence_of(F.col("_barriers")))
    flat["barrier_count"] = F.size("_barriers")
    scored = rows.withColumns({**flat, **_signals_v04()})
    weights = [
        (F.col("has_high_energy_signal"), 0.30),
        (F.col("has_direct_exposure_evidence"), 0.25),
        (F.col("has_caught_between_evidence"), 0.20),
        (F.col("has_severe_consequence_signal") | F.col("has_fatality_evidence"), 0.25),
        (F.col("has_barrier_failure_signal"), 0.10),
    ]
    total = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in weights])
    out = scored.withColumn("sif_precursor_signal_score", F.round(F.least(F.lit(1.0), total), 4))
    return out.select([c for c in out.columns if not c.startswith("_")])


def detailed_v04(df: DataFrame, text: str = "description") -> DataFrame:
    """Nested form for a JSON-lines sink: arrays of label, evidence and, for barriers, status."""
    rows = _v04_items(df, text)
    return rows.select(
        "report_id", _t().alias("description"),
        *[F.col("_" + f).alias(f) for f in ("hazards", "exposures", "consequences", "barriers", "activities")],
    )


def activity_metadata(df: DataFrame, text: str = "description") -> DataFrame:
    """Activities, their evidence and their number for every report."""
    return with_activities(df, text).select("report_id", "activities", "activity_evidence", "activity_count")


def with_activities(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds the activity columns in place, without a join."""
    rows = df.withColumn("_t", m.staged(F.col(text)))
    rows = rows.withColumn("_seen", m.staged(m.begun_words(F.lower("_t"), m.bank_patterns(v04.ACTIVITIES))))
    found = rows.withColumn("_a", m.staged(m.collect_hits(_t(), _seen(), v04.ACTIVITIES, 5)))
    return found.withColumns(
        {
            "activities": F.array_join(F.array_distinct(labels_of(F.col("_a"))), "; "),
            "activity_evidence": F.array_join(F.array_distinct(evidence_of(F.col("_a"))), "; "),
            "activity_count": F.size("_a"),
        }
    ).drop("_t", "_seen", "_a")


def _plain(items: Column) -> Column:
    return F.array_join(items, "; ")


def extract_v05(df: DataFrame, text: str = "description") -> DataFrame:
    """Observed and potential consequences apart; labels may repeat; gaps come before mentions."""
    banks = {
        "hazards": v05.HAZARDS, "exposures": v05.EXPOSURES, "actual_consequences": v05.ACTUAL,
        "potential_consequences": v05.POTENTIAL, "activities": v05.ACTIVITIES, "present": v05.BARRIERS,
    }
    rows = _staged_text(df, text, *banks.values(), v05.GAPS)
    found = rows.withColumns({f"_{k}": m.staged(m.collect_hits(_t(), _seen(), b, 8)) for k, b in banks.items()})
    present = F.transform(
        F.filter("_present", lambda x, i: F.array_position(labels_of(F.col("_present")), x.label) == i + 1),
        lambda x: F.struct(x.label.alias("label"), x.evidence.alias("evidence"), F.lit("present").alias("status")),
    )
    gaps = _some(*[_item(label, _original(p), status=F.lit("failed_or_absent")) for label, p in v05.GAPS])
    found = found.withColumn("_barriers", m.staged(F.concat(gaps, present)))
    families = ("hazards", "exposures", "actual_consequences", "potential_consequences", "activities")
    return found.select("report_id", *_flat_columns(families))


def _flat_columns(families) -> list[Column]:
    """Labels, evidence and count per family, and barriers with their status."""
    columns = {}
    for k in families:
        single = {"activities": "activity"}.get(k, k[:-1])
        columns[k] = _plain(labels_of(F.col("_" + k)))
        columns[f"{single}_evidence"] = _plain(evidence_of(F.col("_" + k)))
        columns[f"{single}_count"] = F.size("_" + k)
    columns["observed_barriers"] = _plain(barrier_text(F.col("_barriers")))
    columns["barrier_evidence"] = _plain(evidence_of(F.col("_barriers")))
    columns["barrier_count"] = F.size("_barriers")
    return [v.alias(k) for k, v in columns.items()]


def potential_consequences(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds _potential: (label, evidence) where mechanism and human exposure both hit; the evidence
    spans both first hits with 50 characters before and 90 after."""

    def of(label: str, mechanism: str, exposure: str) -> Column:
        a, b = (F.regexp_instr(_low(), F.lit(m.unicode_word(p))) for p in (mechanism, exposure))

        def spanned(at: Column) -> Column:
            end_a = at["a"] + F.length(F.regexp_extract(_low(), m.unicode_word(mechanism), 0))
            end_b = at["b"] + F.length(F.regexp_extract(_low(), m.unicode_word(exposure), 0))
            begin = F.greatest(F.least(at["a"], at["b"]) - 50, F.lit(1))
            stop = F.greatest(end_a, end_b) + 90
            return F.when((at["a"] > 0) & (at["b"] > 0), _item(label, squeeze(F.substring(_t(), begin, stop - begin))))

        guards = [g for g in (m.may_hit(_seen(), mechanism), m.may_hit(_seen(), exposure)) if g is not None]
        both = bound(F.struct(a.alias("a"), b.alias("b")), spanned)
        return F.when(reduce(lambda x, y: x & y, guards), both) if guards else both

    rows = df if "_seen" in df.columns else _staged_text(df, text, v06.POTENTIAL)
    return rows.withColumn("_potential", m.staged(F.array_compact(F.array(*[of(*r) for r in v06.POTENTIAL]))))


def extract_v06(df: DataFrame, text: str = "description") -> DataFrame:
    """One evidence per label (the longest), mechanism-aware potentials, barriers with status."""
    banks = {
        "hazards": v06.HAZARDS, "exposures": v06.EXPOSURES, "actual_consequences": v06.ACTUAL, "activities": v06.ACTIVITIES,
    }
    rows = _staged_text(df, text, *banks.values(), v06.POTENTIAL, v06.GAPS, v06.BARRIERS)
    found = rows.withColumns({f"_{k}": m.staged(m.collect_hits(_t(), _seen(), b, 20)) for k, b in banks.items()})
    found = found.withColumns(
        {f"_{k}": m.staged(m.longest_per_label(F.col("_" + k), list(dict(b)))) for k, b in banks.items()}
    )
    found = potential_consequences(found).withColumnRenamed("_potential", "_potential_consequences")
    barriers = [_item(n, _original(p), status=F.lit("failed_or_absent")) for n, p in v06.GAPS]
    barriers += [_item(n, _original(p), status=F.lit("present")) for n, p in v06.BARRIERS]
    found = found.withColumn("_barriers", m.staged(_some(*barriers)))
    kept = [c for c in df.columns if c not in (text, "report_id")]
    families = ("hazards", "exposures", "actual_consequences", "potential_consequences", "activities")
    return found.select("report_id", *kept, *_flat_columns(families))


def _original(pattern: str) -> Column:
    """First hit in the spelling of the text, null without one."""
    found = F.nullif(F.trim(F.regexp_extract(_t(), m.any_case(pattern), 0)), F.lit(""))
    guard = m.may_hit(_seen(), pattern)
    return found if guard is None else F.when(guard, found)
