"""Required words looked for behind word boundaries, and words counted without a boundary test."""

import time

from pyspark.sql import functions as F

from hazardloom.banks import audits, evidence_v15, extraction_v04, extraction_v05, extraction_v06, precursors, structured_features
from hazardloom.functions import matching as m
from hazardloom.functions import text as tx

TEXTS = [
    "", "The hot gas hotel: no, not hot-gas; ARMCHAIR and arm.", "ſkid, sKid and İnjury near the kıck; Kick Knife",
    "Operator was not wearing gloves; finger was caught between belt and roller. Electric ARC, 440 V de-energized.", "xcut cutx _cut cut_ écut cut é-cut",
    "He fell from the ladder at a height of 3 m and was hospitalized; the hand́ was trapped, handé caught, cut shock 9hot",
    "Person standing inside the fenced area without any harness or ladder, 230V, phase-to-ground fault, hand was trapped",
]


def test_a_boundary_before_a_word_is_told_from_the_pattern():
    assert m.listed_words(r"\bhot gas\b") == ((("hot gas", True),),)
    assert m.listed_words(r"\b(?:bad|not)\b.{0,9}\bgloves\b") == ((("bad", True), ("not", True)), (("gloves", True),))
    assert m.listed_words(r"(?:un)?safe") == ((("safe", False),),)
    assert m.listed_words(r"\b(?:un)?safe act") == ((("safe act", False),),)
    assert m.listed_words(r"\bfinger.*caught") == ((("finger", True),),)
    assert m.listed_words(r"\b-off") == ((("-off", False),),)


def test_guards_lose_no_hit(spark):
    banks = [audits.HAZARDS, extraction_v04.HAZARDS, extraction_v04.ACTIVITIES, extraction_v05.BARRIERS, extraction_v06.GAPS, evidence_v15.HAZARDS, evidence_v15.EXPOSURES, *precursors.FEATURES.values()]
    patterns = [*dict.fromkeys(m.bank_patterns(*banks)), r"\b-gas", r"rgy|nergized", r"(?:un)?cut\b"]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("low", F.lower("t"))
    rows = rows.withColumn("seen", m.staged(m.begun_words(F.col("low"), patterns)))
    plain = rows.select(*[F.col("low").rlike("(?U)" + p) for p in patterns], *[F.regexp_extract_all("t", F.lit("(?iU)" + p), 0) for p in patterns]).collect()
    guarded = rows.select(*[m.hits(F.col("low"), p, F.col("seen")) for p in patterns], *[m.occurrences(F.col("t"), F.col("seen"), p) for p in patterns]).collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in guarded]
    assert sum(bool(x) for r in plain for x in r) > 20


def test_word_count_needs_no_boundary(spark):
    texts = [*TEXTS, "áb c‍d _x_ é", "́ ́a", "𝒜b 日本 x-y", "1 2.3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select(tx.word_count(F.col("t")).alias("a"), F.regexp_count("t", F.lit(r"(?U)\b\w+\b")).alias("b")).collect():
        assert r.a == r.b


def test_a_pass_over_a_long_text_costs_little_more_than_reading_it(spark):
    text = "the quick brown operator handed over another reddish conveyor belt to inland harbours " * 20_000
    rows = spark.createDataFrame([(text,)] * 4, "t string").repartition(4).cache()
    rows.count()
    patterns = m.bank_patterns(*precursors.FEATURES.values())

    def seconds(column) -> float:
        best = 1e9
        for _ in range(3):
            start = time.time()
            rows.select(F.length(column)).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - start)
        return best

    assert seconds(m.begun_words(F.col("t"), patterns)) < 0.6 * seconds(m.seen_words(F.col("t"), patterns))
