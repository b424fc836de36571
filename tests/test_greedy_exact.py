"""The greedy split at sizes where groups of equal counts are many: every single decision, and the rows' splits."""

import pytest

from hazardloom.operators import evaluation as ev

CLASSES = {
    "singles": [(1, 1, 0, 9_001), (1, 0, 1, 5_003)],
    "changing": [(2, 2, 0, 50), (2, 1, 1, 100), (1, 1, 0, 10_000), (1, 0, 1, 7_000)],
    "one sided": [(4, 4, 0, 6_000), (1, 0, 1, 9_000)],
}


def one_by_one(classes):
    """The split of every group, decided by the rule as it is written."""
    whole = [sum(c[k] * c[3] for c in classes) for k in range(3)]
    totals, out = {s: [0, 0, 0] for s, _ in ev.GREEDY_SHARES}, []
    for *size, n in classes:
        for _ in range(n):
            error = lambda s, share: sum(w * (abs(totals[s][k] + size[k] - whole[k] * share) / max(whole[k] * share, 1.0)) for k, w in enumerate(ev.GREEDY_WEIGHTS))
            best = min(ev.GREEDY_SHARES, key=lambda x: error(*x))[0]
            totals[best] = [a + b for a, b in zip(totals[best], size)]
            out.append(best)
    return out


def in_order(runs):
    return [s for _, a, b, s in runs for _ in range(b - a)]


@pytest.mark.parametrize("name", CLASSES)
def test_every_group_is_decided_by_itself(name):
    assert in_order(ev.greedy_runs(CLASSES[name])) == one_by_one(CLASSES[name])


def test_stretches_of_any_length_decide_alike(monkeypatch):
    monkeypatch.setattr(ev, "STRETCH", 64)
    assert all(in_order(ev.greedy_runs(c)) == one_by_one(c) for c in CLASSES.values())


def test_rows_follow_the_decisions(spark, monkeypatch):
    monkeypatch.setattr(ev, "STRETCH", 256)
    groups = spark.range(9_000).selectExpr("concat('g', id) g", "if(id < 5200, 'YES', 'NO') label")
    rows = groups.selectExpr("concat('r', g) report_id", "g", "label")
    got = {r.g: r.split for r in ev.greedy_group_split(rows, "g", "label").collect()}
    keyed = groups.withColumn("h", ev.hash_number(ev.F.lit("split"), ev.F.col("g"))).orderBy(ev.F.desc("label"), "h", "g").collect()
    assert len(got) == 9_000 and [got[r.g] for r in keyed] == one_by_one([(1, 1, 0, 5_200), (1, 0, 1, 3_800)])
