"""Order of the active batch."""

from hazardloom.operators import selection as se


def test_equal_disagreements_of_the_first_pass_go_by_id(spark):
    rows = [("r2", "a", 0.5, 0.9, 0.1), ("r1", "a", 0.5, 0.1, 0.1), ("r3", "a", 0.5, 0.5, 0.1), ("r0", "a", 0.5, 0.9, 0.7), ("r9", "a", 0.5, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "report_id string, risk string, model_disagreement double, boundary_uncertainty double, ranking_score double")
    got = se.select_active_batch(df, size=5, cap=4).orderBy("active_learning_rank").collect()
    assert [r.report_id for r in got] == ["r0", "r1", "r2", "r3", "r9"]
