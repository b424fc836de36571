"""Bootstrap with ids: every row is drawn by itself."""

import hashlib

import numpy as np
import pytest

from hazardloom.operators import evaluation as ev


def plain(rows, reps, threshold):
    """Accuracy and average precision of the replicates, with each row's weights."""
    w = ev.row_weights([r[0] for r in rows], reps).astype(int)
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    right = w[(s >= threshold) == (y == 1)].sum(0) / w.sum(0)
    gain = np.zeros(reps)
    for v in np.unique(s):
        gain += w[(s == v) & (y == 1)].sum(0) * (w[(s >= v) & (y == 1)].sum(0) / np.maximum(w[s >= v].sum(0), 1))
    return {"accuracy": right, "pr_auc": gain / w[y == 1].sum(0)}


@pytest.mark.parametrize("block", [7, 1024])
def test_rows_of_equal_scores_have_their_own_draws(spark, monkeypatch, block):
    monkeypatch.setattr(ev, "BLOCK_ROWS", block)
    r = np.random.Generator(np.random.PCG64(5))
    rows = [(f"r{i}", 0.5 if i % 3 else round(float(r.random()), 2), int(r.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "report_id string, s double, y int")
    got = {x.metric: (x.ci_low, x.ci_high, x.valid_samples) for x in ev.bootstrap_ci(df, "s", "y", 0.5, 200, "report_id").collect()}
    for name, values in plain(rows, 200, 0.5).items():
        assert got[name] == (*(pytest.approx(float(x), abs=2e-9) for x in np.quantile(values, [0.025, 0.975])), 200)


def test_weights_are_poisson():
    w = ev.row_weights([f"report_{i:06d}" for i in range(40)], 5000).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_draws_are_those_of_md5():
    names = ["", "a", "report_000001", "é" * 9, "x" * 51, "y" * 54, "z" * 90]
    bounds, total, term = [], 0.0, np.exp(-1)
    for k in range(12):
        total, term = total + term, term / (k + 1)
        bounds.append(total)
    for name, got in zip(names, ev.row_weights(names, 4099)):
        digests = b"".join(hashlib.md5(f"{k}|{name}".encode()).digest() for k in range(1025))
        draws = np.frombuffer(digests, ">u4")[:4099] / 2.0**32
        assert (got == np.searchsorted(bounds, draws, "right")).all()
