"""Fitted packages and joint cross-validation against models fitted one by one on prepared rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardloom.operators import training as tr

SCHEMA = "report_id string, truth int, folds array<int>, v array<float>, a double, b int, c double, never double, same int"


def table(seed=3, n=240, repeats=2, folds=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.gauss(40, 10), r.randint(0, 1)
        c = r.gauss(0, 1) if r.random() < 0.6 else None
        v = [r.gauss(0, 1) for _ in range(3)] if r.random() < 0.9 else None
        y = int(0.1 * (a - 40) + b + (c or 0) + (v[0] if v else 0) + r.gauss(0, 1) > 0.5)
        rows.append((f"r{i}", y, [r.randrange(folds) for _ in range(repeats)], v, a, b, c, None, 7))
    return rows


COLUMNS = ["a", "b", "c", "never", "same"]


def plain_fit(rows, held, c, columns, vector=True):
    """Prepared training features, weights of a balanced L2 model, and the scores of the held rows."""
    names = {"a": 4, "b": 5, "c": 6, "never": 7, "same": 8}
    raw = lambda rs: np.array([[np.nan if x[names[k]] is None else float(x[names[k]]) for k in columns] for x in rs]).reshape(len(rs), -1)
    x, xh = raw(rows), raw(held)
    keep = ~np.isnan(x).all(0)
    x, xh = x[:, keep], xh[:, keep]
    flags = np.isnan(x).any(0)
    median = np.nanmedian(x, axis=0)
    parts = [(np.where(np.isnan(z), median, z), np.isnan(z)[:, flags].astype(float)) for z in (x, xh)]
    vec = lambda rs: np.array([(*(x[3] or (0.0, 0.0, 0.0)), float(x[3] is None)) for x in rs]).astype(np.float32).astype(float)
    whole = [np.concatenate([*([vec(rs)] if vector else []), *p], axis=1) for rs, p in ((rows, parts[0]), (held, parts[1]))]
    mean, spread = whole[0].mean(0), whole[0].std(0)
    spread = np.where(spread > 1e-9 * (1 + abs(mean)), spread, 1)
    u, uh = (np.concatenate([(w - mean) / spread, np.ones((len(w), 1))], axis=1) for w in whole)
    y = np.array([r[1] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, penalty = np.zeros(u.shape[1]), np.ones(u.shape[1])
    penalty[-1] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-u @ w))
        slope = c * u.T @ (weight * (p - y)) + penalty * w
        w = w - np.linalg.solve(c * (u * (weight * p * (1 - p))[:, None]).T @ u + np.diag(penalty + 1e-12), slope)
    return 1 / (1 + np.exp(-uh @ w)), median, flags, keep


def stored(spark, rows):
    return tr.stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "test-rows")


def test_all_folds_and_penalties_in_one_job(spark):
    rows = table()
    df = stored(spark, rows)
    layout = tr.layout_of(df, COLUMNS, "v")
    assert layout.nullable == ("c", "never") and layout.width == 3
    sets = [("all", None, True), ("plain", ("a", "c"), False)]
    specs = [tr.Spec(n, r, f, c, cols, vec) for n, cols, vec in sets for r in range(2) for f in range(3) for c in (0.1, 1.0)]
    got = {(x.report_id, x.model, x.repeat, x.c): x for x in tr.cross_validated(df, layout, specs, 3).collect()}
    assert len(got) == len(rows) * 2 * 2 * 2
    for s in specs:
        train, held = ([x for x in rows if (x[2][s.repeat] != s.out) == side] for side in (True, False))
        want, *_ = plain_fit(train, held, s.c, list(s.columns or COLUMNS), s.with_vector)
        for x, p in zip(held, want, strict=True):
            one = got[x[0], s.name, s.repeat + 1, s.c]
            assert one.fold == s.out == x[2][s.repeat] and one.score == pytest.approx(p, abs=1e-6)


def test_package_round_trip_and_refusals(spark, tmp_path):
    rows = table(5)
    df = spark.createDataFrame(rows, SCHEMA)
    package = tr.fit_package(df, COLUMNS, "v", c=0.5)
    want, median, _, _ = plain_fit(rows, rows, 0.5, COLUMNS)
    got = {x.report_id: x.score for x in package.score(df).collect()}
    assert all(got[x[0]] == pytest.approx(p, abs=1e-6) for x, p in zip(rows, want, strict=True))
    by_name = {f["name"]: f for f in package.features}
    assert not by_name["never"]["kept"] and by_name["never"]["values"] == 0 and by_name["never"]["weight"] == 0
    assert by_name["c"]["median"] == pytest.approx(median[2]) and by_name["c_missing"]["kept"] and not by_name["never_missing"]["kept"]
    package.save(spark, str(tmp_path / "m"))
    again = tr.Package.load(spark, str(tmp_path / "m"))
    assert again == package and {x.report_id: x.score for x in again.score(df).collect()} == got
    for changed, what in ((df.drop("b"), "b is missing"), (df.withColumn("b", F.col("b").cast("string")), "b is string, not int"), (df.drop("v"), "v is missing")):
        with pytest.raises(ValueError, match=what):
            again.score(changed)
    with pytest.raises(Exception, match="width is not 3"):
        again.score(df.withColumn("v", F.slice("v", 1, 2))).collect()
    with pytest.raises(ValueError, match="not numbers"):
        tr.fit_package(df, ["report_id"])


def test_one_class_and_no_rows(spark):
    rows = [(f"r{i}", 1, [0, 0], None, float(i), 1, None, None, 2) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {x.score for x in tr.fit_package(df, COLUMNS, "v").score(df).collect()} == {0.5}
    empty = tr.fit_package(df.limit(0), ["a", "c"])
    assert {x.score for x in empty.score(df).collect()} == {0.5}


def test_unseen_nulls_and_null_vectors_are_scored(spark):
    rows = table(9)
    full = [x for x in rows if x[3] is not None]
    package = tr.fit_package(spark.createDataFrame(full, SCHEMA), ["a", "b"], "v")
    holes = spark.createDataFrame([("x", None, [0], None, None, None, None, None, 1)], SCHEMA)
    assert 0 < package.score(holes).first().score < 1
