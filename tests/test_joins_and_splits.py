"""Validated joins, overlaps and the greedy split against plain versions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from hazardloom.operators import evaluation as ev
from hazardloom.operators import preparation as pr


def test_validated_join_with_every_fault_and_clashing_names(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), (None, 6)], "k string, _made0 int")
    right = spark.createDataFrame([("a", "x"), ("c", "y"), ("c", "z"), ("d", None), ("e", "w"), (None, "n")], "k string, _MADE1 string")
    rows, broken = pr.validated_join(left, right, "k")
    assert rows.columns == ["k", "_made0", "_MADE1"]
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [("a", 1, "x"), ("a", 2, "x"), ("b", 3, None), ("c", 4, None), ("d", 5, None), (None, 6, None)]))
    want = {("a", 2, 1, "left_repeated"), ("b", 1, 0, "missing"), ("c", 1, 2, "right_repeated"), (None, 1, 0, "missing")}
    assert set(map(tuple, broken.collect())) == want
    assert set(map(tuple, pr.validated_join(left, right, "k", one_to_one=False)[1].collect())) == {w for w in want if w[3] != "left_repeated"}
    assert pr.validated_join(left.limit(0), right, "k")[0].count() == 0


def test_overlap_of_every_two_tables(spark):
    sets = {"p": {1, 2, 3, 4}, "q": {3, 4, 5}, "r": set(), "s": {4}}
    tables = {n: spark.createDataFrame([(x,) for x in [*v, *v]] + [(None,)], "id int") for n, v in sets.items()}
    got = {(r.a, r.b): r.shared for r in ev.pairwise_overlap(tables, "id").collect()}
    names = list(sets)
    assert got == {(a, b): len(sets[a] & sets[b]) for j, b in enumerate(names) for a in names[:j]}


def one_by_one(groups):
    """The greedy rule a group at a time; totals per split."""
    whole = [sum(g[k] for g in groups) for k in range(3)]
    totals = {s: [0, 0, 0] for s, _ in ev.GREEDY_SHARES}
    for g in groups:
        error = lambda s, share: sum(w * (abs(totals[s][k] + g[k] - share * whole[k]) / max(share * whole[k], 1.0)) for k, w in enumerate(ev.GREEDY_WEIGHTS))
        best = min(ev.GREEDY_SHARES, key=lambda x: error(*x))[0]
        totals[best] = [a + b for a, b in zip(totals[best], g)]
    return totals


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3), st.integers(1, 30)), min_size=1, max_size=6, unique_by=lambda x: x[:2]))
def test_runs_over_classes_are_the_greedy_of_single_groups(found):
    classes = sorted(((n, min(y, n), n - min(y, n), m) for n, y, m in found), key=lambda c: (-c[0], -abs(c[1] - c[2]), -c[1]))
    totals = {s: [0, 0, 0] for s, _ in ev.GREEDY_SHARES}
    runs = ev.greedy_runs(classes)
    for c, a, b, s in runs:
        totals[s] = [t + (b - a) * x for t, x in zip(totals[s], classes[c])]
    each = [c[:3] for c in classes for _ in range(c[3])]
    want = one_by_one(each)
    if all(w[0] for w in want.values()):
        assert totals == want
    assert sum(b - a for _, a, b, _ in runs) == len(each)
    assert len(each) < 3 or sum(bool(t[0]) for t in totals.values()) == 3


def test_many_alike_groups_take_bounded_decisions():
    runs = ev.greedy_runs([(2, 1, 1, 10**7), (1, 1, 0, 10**9)])
    assert len(runs) < 10_000 and sum(b - a for *_, a, b, _ in [(r[0], r[1], r[2], r[3]) for r in runs]) == 10**7 + 10**9


def test_no_group_in_two_splits(spark):
    r = random.Random(3)
    rows = [(f"r{i}", f"g{r.randrange(60)}", r.choice(["YES", "NO"])) for i in range(300)]
    got = ev.greedy_group_split(spark.createDataFrame(rows, "report_id string, g string, label string"), "g", "label").collect()
    assert len(got) == 300 and all(len({x.split for x in got if x.g == g}) == 1 for g in {x.g for x in got})
    assert {x.split for x in got} == {"train", "validation", "test"}
