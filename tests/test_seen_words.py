"""Required words found in one pass, and tests in front of a regex."""

import re

from pyspark.sql import functions as F

from hazardloom.banks import evidence_v15, extraction_v04, extraction_v06
from hazardloom.functions import matching as m

TEXTS = [
    "", "The hot gas hotel: no, not hot-gas; ARMCHAIR and arm.", "ſkid, sKid and İnjury near the kıck",
    "Operator was not wearing gloves; finger was caught between belt and roller. Electric ARC, 440 V de-energized.", "xcut cutx _cut cut_ écut cut",
]


def test_words_of_one_pass_are_the_substrings(spark):
    patterns = m.bank_patterns(extraction_v04.HAZARDS, extraction_v06.GAPS, evidence_v15.HAZARDS, [("x", r"\b(?:hot gas|hotel|hot|no|not|arm|armchair)\b")])
    words = sorted({w for p in patterns for g in m.required_words(p) for w in g})
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(F.lower("t").alias("t"))
    got = rows.select("t", F.col("t").alias("low"), m.seen_words(F.col("t"), patterns).alias("seen")).collect()
    for r in got:
        assert [w for w in words if w in r.seen] == [w for w in words if w in r.low]


def test_tests_in_front_change_no_match(spark):
    patterns = [r"\b(?:skid|kick|cut)\b", r"(?:hot|arm)\w*", r"\binjury|cut\b", r"\b\d{2,4} v\b", r"\b(?:no|not)\b.{0,20}\bgloves\b", r"\w+"]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in patterns:
        for flags, made in (("(?U)", m.unicode_word(p)), ("(?iU)", m.any_case(p))):
            r = rows.select(F.regexp_extract_all("t", F.lit(flags + p), 0).alias("a"), F.regexp_extract_all("t", F.lit(made), 0).alias("b")).collect()
            assert [x.a for x in r] == [x.b for x in r]
    assert re.match(r"\(\?iU\)\(\?-i:", m.any_case(patterns[0]))
