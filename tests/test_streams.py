"""Streams over folders of part files, empty tables and successive arrivals; ids that never cut."""

import pytest
from pyspark.sql import functions as F

from hazardloom.functions import text as tx
from hazardloom.streaming import streams

ROWS = "report_id string, id long, decision string"


def table(spark, path, rows):
    spark.createDataFrame(rows, ROWS).repartition(3).write.mode("append").parquet(f"{path}/log.parquet")


def upsert(spark, path):
    latest = streams.latest_stream(streams.file_stream(spark, str(path), "log"))
    return streams.upsert_available(latest, f"{path}/latest", f"{path}/state", "report_id", "id")


def test_folder_of_part_files_and_two_arrivals(spark, tmp_path):
    table(spark, tmp_path, [("a", 1, "CONFIRMED"), ("b", 2, "REJECTED"), ("a", 5, "REJECTED"), ("c", 3, "CONFIRMED")])
    assert sorted((r.report_id, r.id, r.decision) for r in upsert(spark, tmp_path).collect()) == [("a", 5, "REJECTED"), ("b", 2, "REJECTED"), ("c", 3, "CONFIRMED")]
    table(spark, tmp_path, [("b", 9, "CONFIRMED"), ("a", 4, "CONFIRMED"), ("d", 8, "REJECTED")])
    after = upsert(spark, tmp_path)
    assert sorted((r.report_id, r.id) for r in after.collect()) == [("a", 5), ("b", 9), ("c", 3), ("d", 8)]
    assert {r.decision: r.reports for r in streams.decision_counts(after).collect()} == {"REJECTED": 2, "CONFIRMED": 2}


def newest(rows):
    return sorted((r.report_id, r.id, r.decision) for r in rows.collect())


def log_table(spark, path):
    from pyspark.sql.types import _parse_datatype_string

    return streams.NewestTable(spark, f"{path}/latest", _parse_datatype_string(ROWS), "report_id", "id")


def test_readers_see_the_version_before_or_after_a_batch(spark, tmp_path):
    made = log_table(spark, tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert newest(made.read()) == []
    made.add(frame([("a", 1, "x"), ("b", 2, "x"), ("a", 3, "y")]), 0)
    first = [("a", 3, "y"), ("b", 2, "x")]
    assert newest(made.read()) == first
    seen, publish = [], made.publish
    made.publish = lambda *event: (seen.append(newest(made.read())), publish(*event))
    made.add(frame([("b", 1, "late"), ("c", 9, "z")]), 1)
    assert seen == [first] and newest(made.read()) == [*first, ("c", 9, "z")]
    # compaction beside a reader and a batch: the version that a reader has stays readable
    held = made.read()
    assert made.compact() and not made.compact()
    made.publish = publish
    made.add(frame([("a", 4, "w")]), 2)
    assert newest(held) == [*first, ("c", 9, "z")]
    assert newest(made.read()) == [("a", 4, "w"), ("b", 2, "x"), ("c", 9, "z")]
    assert made.live()[0].rsplit("/", 1)[1].startswith("base-000000001") and len(made.live()[1]) == 1


def test_a_batch_that_is_killed_runs_again_once(spark, tmp_path, monkeypatch):
    table(spark, tmp_path, [("a", 1, "x"), ("b", 2, "x")])
    assert newest(upsert(spark, tmp_path)) == [("a", 1, "x"), ("b", 2, "x")]
    table(spark, tmp_path, [("a", 5, "y"), ("c", 6, "y")])

    def killed(self, *event):
        raise RuntimeError("killed before the event")

    with monkeypatch.context() as m:
        m.setattr(streams.NewestTable, "publish", killed)
        with pytest.raises(Exception, match="killed"):
            upsert(spark, tmp_path)
    assert newest(log_table(spark, tmp_path).read()) == [("a", 1, "x"), ("b", 2, "x")]
    after = [("a", 5, "y"), ("b", 2, "x"), ("c", 6, "y")]
    assert newest(upsert(spark, tmp_path)) == after
    # a batch whose event is there is not written again
    made = log_table(spark, tmp_path)
    number = made.live()[2]
    made.add(spark.createDataFrame([("a", 99, "twice")], ROWS), number)
    made.publish("delta", number, made.live()[1][-1])
    assert newest(made.read()) == after


def test_deltas_are_merged_after_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT_AFTER", 2)
    for n in range(3):
        table(spark, tmp_path, [(k, 10 * n + i, f"d{n}") for i, k in enumerate("abc")])
        assert newest(upsert(spark, tmp_path)) == [(k, 10 * n + i, f"d{n}") for i, k in enumerate("abc")]
    assert log_table(spark, tmp_path).live()[0] is not None


def test_append_reads_all_part_files_and_empty_input(spark, tmp_path):
    table(spark, tmp_path, [])
    source = lambda: streams.file_stream(spark, str(tmp_path), "log")
    assert streams.append_available(source(), f"{tmp_path}/out", f"{tmp_path}/s1").count() == 0
    table(spark, tmp_path, [(str(i), i, "x") for i in range(20)])
    assert streams.append_available(source(), f"{tmp_path}/out", f"{tmp_path}/s1").count() == 20


@pytest.mark.parametrize(("number", "text"), [(7, "000007"), (999_999, "999999"), (1_000_000, "1000000"), (12_345_678, "12345678")])
def test_ids_are_never_cut(spark, number, text):
    row = spark.range(1).select(tx.padded_id("report_", F.lit(number)).alias("a"), tx.normalise_id(F.lit(f"{number}.0")).alias("b")).first()
    assert tuple(row) == (f"report_{text}", text)


def test_sentences_are_those_of_a_multiline_search(spark):
    import re

    from hazardloom.functions import matching

    texts = ["first line\nsecond line.\nthird", "a. b\n\nc!", "one\r\ntwo.", "", "no end", "x y. z\n"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.size(matching.sentence_offsets(F.col("t"))).alias("n"))
    want = {i: sum(1 for m in re.finditer(r"[^.!?\n]+(?:[.!?]+|$)", t, re.M) if m.group().strip()) for i, t in enumerate(texts)}
    assert {r.i: r.n for r in found.collect()} == want
