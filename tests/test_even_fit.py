"""Rows of a fit are dealt out to all cores, groups are hashed once, and a model's products take its own columns alone."""

import numpy as np
from pyspark.sql import functions as F

from hazardloom.operators import training as tr
from hazardloom.plans import evaluation_queries as eq
from hazardloom.plans import tables as tb
from hazardloom.plans import training_queries as tq

SF = "/root/testdata/sf0.001"


def test_folded_rows_are_one_part_a_core(spark):
    rows = tq._folded(spark, SF)
    parts = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert len(parts) == spark.sparkContext.defaultParallelism
    assert max(parts) < 2 * sum(parts) / len(parts)


def test_groups_are_stored_and_those_of_all_labelled_reports(spark):
    first, again = eq._grouped(spark, SF), eq._grouped(spark, SF)
    assert first.inputFiles() == again.inputFiles() != []
    from hazardloom.operators import preparation as pr

    want = pr.hashed_groups(tb.labelled(spark, SF), "raw_text").select("report_id", "label", "truth", F.col("derived_group_id").alias("duplicate_group_id"))
    assert first.columns == want.columns and first.exceptAll(want).count() == want.exceptAll(first).count() == 0 < want.count()


def test_products_of_own_columns():
    rng = np.random.default_rng(3)
    z, bend = rng.normal(size=(2500, 7)), rng.uniform(size=(2500, 3))
    sums = np.zeros((3, 7 * 7 + 8))
    tr.curvatures(z, bend, [(np.array([0, 2, 6]), np.array([0, 2])), (np.arange(7), np.array([1]))], sums)
    for m, columns in ((0, [0, 2, 6]), (1, range(7)), (2, [0, 2, 6])):
        want = np.zeros((7, 7))
        want[np.ix_(columns, columns)] = ((z * bend[:, m : m + 1]).T @ z)[np.ix_(columns, columns)]
        assert np.allclose(sums[m, :49].reshape(7, 7), want)
    assert not sums[:, 49:].any()
