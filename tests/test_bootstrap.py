"""Bootstrap draws: their distribution, and intervals against index draws."""

import numpy as np
import pytest

from hazardloom.operators import evaluation as ev


@pytest.mark.parametrize("n", [1, 3, 40, 200, 201, 5000, 10**7])
def test_counts_are_poisson(n):
    cells = np.arange(1, 61)
    got = ev.poisson_counts(np.full(60, n), (2 * cells + 1) % ev.PRIME, ev.replicate_numbers(2000))
    assert abs(got.mean() - n) < 5 * np.sqrt(n / got.size) and abs(got.var() / n - 1) < 0.05
    skew = ((got - got.mean()) ** 3).mean() / got.std() ** 3
    assert abs(skew - n**-0.5) < 0.06
    # neither cells nor replicates go together
    both = np.corrcoef(got)
    assert np.abs(both[np.triu_indices(60, 1)]).max() < 0.11
    assert np.abs(np.corrcoef(got[:, :60].T)[np.triu_indices(60, 1)]).mean() < 0.14


def test_no_rows_are_never_drawn():
    assert not ev.poisson_counts(np.zeros(3, int), np.arange(3), ev.replicate_numbers(4)).any()


def test_intervals_over_blocks_are_near_those_of_index_draws(spark, monkeypatch):
    r = np.random.Generator(np.random.PCG64(4))
    truth = (r.random(500) < 0.4).astype(int)
    score = np.round(np.clip(0.3 * truth + r.random(500) * 0.7, 0, 1), 2)
    df = spark.createDataFrame(list(zip(score.tolist(), truth.tolist())), "s double, y int")
    whole = {x.metric: (x.ci_low, x.ci_high, x.valid_samples) for x in ev.bootstrap_ci(df, "s", "y", 0.5, 800).collect()}
    monkeypatch.setattr(ev, "CELLS", 7)
    cut = {x.metric: (x.ci_low, x.ci_high, x.valid_samples) for x in ev.bootstrap_ci(df, "s", "y", 0.5, 800).collect()}
    assert all(cut[m] == pytest.approx(whole[m], abs=1e-8) for m in whole)
    draws = []
    for _ in range(800):
        i = r.integers(0, 500, 500)
        s, y = score[i], truth[i]
        order = np.argsort(-s, kind="stable")
        values, first = np.unique(-s[order], return_index=True)
        ends = np.append(first[1:], len(s))
        tp = np.cumsum(y[order])[ends - 1]
        ap = float((np.diff(np.concatenate([[0], tp])) * tp / ends).sum() / y.sum())
        hit = s >= 0.5
        draws.append((((hit == (y == 1)).mean()), y[hit].mean(), hit[y == 1].mean(), ap))
    for name, values in zip(("accuracy", "precision", "recall", "pr_auc"), np.array(draws).T):
        low, high = np.quantile(values, [0.025, 0.975])
        assert whole[name][2] == 800 and abs(whole[name][0] - low) < 0.02 and abs(whole[name][1] - high) < 0.02
