"""Held-out accuracy, the numerical parts against direct solutions, and the awkward cases."""

import zlib

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import quality_classifier as qc

LABELS = "doc_id long, quality int, toxic int"
MORE = SF.replace("0.001", "0.01")


def auc(scores, truth):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    values = np.asarray(scores)[order]
    for v in np.unique(values):
        same = np.flatnonzero(values == v)
        ranks[order[same]] = same.mean() + 1
    pos = np.asarray(truth) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_ranking(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = qc.query(spark, MORE).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert auc([r.score for r in out], [truth[r.doc_id] for r in out]) > 0.95
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.93


def test_features_approximate_the_kernel():
    r = np.random.default_rng(0)
    d = len(qc.STATISTICS)
    x = r.normal(size=(30, d))
    model = qc.Model(np.zeros(d), np.ones(d), r.normal(0, np.sqrt(2 * qc.GAMMA), (d, 4000)), r.uniform(0, 2 * np.pi, 4000))
    z = model.features(x)[:, :-1]
    exact = np.exp(-qc.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.12


def test_pooling_rises_and_keeps_the_mean():
    r = np.random.default_rng(2)
    x, y, w = np.arange(200) / 200, (r.random(200) < np.arange(200) / 200).astype(float), r.integers(1, 5, 200).astype(float)
    at, fit = qc.pool_adjacent(x, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(fit) > 0).all() and 0 <= fit.min() and fit.max() <= 1


def test_normal_equations_are_those_of_all_rows(spark):
    x = np.random.default_rng(1).normal(size=(120, len(qc.STATISTICS)))
    y = (x[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(list(map(float, a)), int(b), i % 4 == 0) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, label int, calibrates boolean")
    model = qc.fit(rows.repartition(5), features=20)
    used = np.arange(120) % 4 != 0
    z = model.features(x[used])
    penalty = np.eye(21) * qc.RIDGE
    penalty[-1, -1] = 1e-6
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y[used]))


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark, AWKWARD, [None, 1, 1, *range(3, len(AWKWARD))]))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 0, 0), (4, None, 0), (5, 7, 0), (99, 0, 0)], LABELS)
    assert len(qc.op2(docs, labels).collect()) == len(AWKWARD)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in qc.op2(docs, none).collect()} == {0.5}
    kept = qc.filtered(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD)
    clashing = docs.selectExpr("*", "1 as _qc0", "2 as _own0", "3 as _OWN1")
    assert qc.filtered(clashing, labels).columns == clashing.columns
    assert qc.op2(documents(spark, []), labels).collect() == []


def test_rejected_rows_go(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    gone = {r.doc_id for r in qc.op2(docs, labels).where("predicted = 0").collect()}
    assert {r.doc_id for r in qc.filtered(docs, labels).collect()} == set(range(1000)) - gone


def test_statistics_have_one_row_a_text():
    x = qc.statistics(pa.array(AWKWARD))
    assert x.shape == (len(AWKWARD), len(qc.STATISTICS)) and np.isfinite(x).all()
