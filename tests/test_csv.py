"""CSV with quoted line breaks, read in many splits, against the reader that takes a file as a whole."""

import csv
import io
import random

import pytest

from hazardloom.sources import files

FIELDS = ["", "plain", "007", 'say "so"', "two\nlines", 'a\n"\n""\nb', ",", "é, ☃", " edge ", "x" * 300, "\n", '"', "five\n\n\n\nlines"]


def whole(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def written(r, n, end, fields=FIELDS):
    out = io.StringIO()
    rows = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    rows.writerow(["id", "a col", "text"])
    for i in range(n):
        rows.writerow([f"{i:05d}", r.choice(fields), r.choice(fields)])
    return out.getvalue()


def same(spark, path):
    got, want = files.read_table_csv(spark, path), whole(spark, path)
    assert got.columns == want.columns
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(got.collect()) == key(want.collect())
    return got


@pytest.mark.parametrize("split", [64, 517, 10_000_000])
def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path, split):
    r = random.Random(split)
    (tmp_path / "t.csv").write_text(written(r, 200, "\n"), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = same(spark, str(tmp_path / "t.csv"))
        assert got.count() == 200 and (split > 10_000 or files.csv_records(spark, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 8)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_carriage_returns_and_folders(spark, tmp_path):
    r = random.Random(4)
    plain = [f for f in FIELDS if "\n" not in f] + ["two\r\nlines"]
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.csv").write_text(written(r, 40, "\r\n", plain), newline="")
    assert same(spark, str(tmp_path / "in")).count() == 120


def test_header_alone_and_raw_columns(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,text\n")
    assert files.read_table_csv(spark, str(tmp_path / "h.csv")).collect() == []
    with pytest.raises(ValueError, match="missing columns"):
        files.read_raw_incidents(spark, str(tmp_path / "h.csv"))
