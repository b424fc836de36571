"""Long texts with many hits cost one pass a pattern."""

import time

from pyspark.sql import functions as F

from hazardloom.functions import matching as m
from hazardloom.functions import text as tx


def test_distinct_ignoring_case_of_a_list_and_of_none(spark):
    rows = spark.createDataFrame([("A b a C B c",)], "t string").select(tx.distinct_ignoring_case(F.split("t", " ")).alias("x"))
    assert rows.first().x == ["A", "b", "C"]
    assert spark.range(1).select(tx.distinct_ignoring_case(F.lit(None).cast("array<string>")).alias("x")).first().x is None


def test_many_hits_of_a_long_text(spark):
    text = "Cut by a knife. " * 20_000 + "CUTTING edge. "
    rows = spark.createDataFrame([(text,)], "t string").withColumn("low", F.lower("t"))
    begin = time.time()
    got = rows.select(m.collect_hits(F.col("t"), F.col("low"), [("Cut", r"\bcut(?:ting)?\b"), ("Knife", r"\bknife\b")], 8).alias("x")).first().x
    assert [tuple(x) for x in got] == [("Cut", "Cut"), ("Cut", "CUTTING"), ("Knife", "knife")]
    places = rows.select(F.size(m.located_hits(F.substring("t", 1, 16_000), r"Cut")).alias("n")).first().n
    assert places == 1_000 and time.time() - begin < 30
