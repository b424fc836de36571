"""File round trips, schema checks and the feature policy."""

import pytest

from hazardloom.operators import extraction, modelling, preparation
from hazardloom.sources import files


def raw(spark):
    row = ("7", "2016-01-05", " Country_01 ", "Local_01", "Mining", "I", "IV", "Male", "Third Party", "Cut; ;Fall", "Line one\nline two")
    return spark.createDataFrame([row], files.RAW_SCHEMA)


def test_raw_csv_to_canonical_parquet(spark, tmp_path):
    files.write_table_csv(raw(spark), str(tmp_path / "raw"))
    back = files.read_raw_incidents(spark, str(tmp_path / "raw"))
    files.write_canonical(preparation.canonical_reports(back), str(tmp_path / "canonical"))
    row = files.read_canonical(spark, str(tmp_path / "canonical")).first()
    assert (row.report_id, row.site, row.timestamp) == ("industrial_safety_000007", "Country_01", "2016-01-05T00:00:00")
    assert (row.hazards, row.description, row.near_miss, row.barriers) == (["Cut", "Fall"], "Line one\nline two", None, [])


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Critical Risk"):
        files.require_columns(raw(spark).drop("Critical Risk"), list(preparation.RAW_COLUMNS.values()))
    assert "label" in files.first_existing(raw(spark), ["nope", "GENRE"], "label").columns


def test_detailed_extraction_as_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", "Worker fell from the ladder without harness.")], ["report_id", "description"])
    files.write_json_lines(extraction.detailed_v04(df), str(tmp_path / "detail"))
    row = spark.read.json(str(tmp_path / "detail")).first()
    assert {h.label for h in row.hazards} == {"Fall-from-height energy"}
    assert [(b.label, b.status) for b in row.barriers] == [("Fall protection", "failed_or_absent")]


def test_feature_policy(spark):
    df = spark.createDataFrame([(1, 0.5, 2, "x")], ["hazard_count", "p", "injury_flag", "name"])
    got = {r.column: (r.allowed, r.reason) for r in modelling.feature_policy(df).collect()}
    assert got == {"hazard_count": (True, ""), "p": (False, "exact"), "injury_flag": (False, "contains injury"), "name": (False, "type")}


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 0.0), ("c", 0.9, 1.0), ("d", 0.2, 0.0)], ["report_id", "x", "truth"])
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = modelling.logistic(train, "truth", 1.0)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = LogisticRegressionModel.load(str(tmp_path / "model"))
    assert [r.score for r in modelling.score(again, train).orderBy("report_id").collect()] == [r.score for r in modelling.score(model, train).orderBy("report_id").collect()]
