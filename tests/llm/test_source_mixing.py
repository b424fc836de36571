"""Source mixing: targets against the plain rule, roundings against what they keep."""

import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, SCHEMA, SF, documents, with_clashes

from hazardloom.llm import source_mixing


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


def plain_targets(words, weights=(5, 2, 1), share=1.5, most=2):
    """Share by weight, stop those above their limit, share the excess anew until none is above."""
    names = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, open_, out = share * sum(words.values()), set(names), {}
    while open_:
        each = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if each[s] > most * words[s]}
        if not over:
            return out | each
        for s in over:
            out[s] = most * words[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, docs):
    """docs: list of (doc_id, text, source). Every row's size, target and bounds; returns the words taken per source."""
    words, most = defaultdict(int), defaultdict(int)
    size = lambda t: len((t or "").encode().split())
    for _, t, s in docs:
        words[s] += size(t)
        most[s] = max(most[s], size(t))
    want = plain_targets(words)
    assert sorted((r.doc_id, r.size, r.source_size) for r in rows) == sorted((i, size(t), words[s]) for i, t, s in docs)
    source = {i: s for i, _, s in docs}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size) and (not r.size or r.taken // r.size in (int(r.target / r.source_size), int(r.target / r.source_size) + 1))
        taken[s] += r.taken
    for s in words:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6
    return taken, want


def invented(r, n, sources):
    return [(i, " ".join("w" for _ in range(int(r.paretovariate(1.1) * 5) % 900)), sources[min(int(r.expovariate(1.2)), len(sources) - 1)]) for i in range(n)]


@pytest.mark.parametrize("leaf", [1024, 7])
def test_targets_and_words_taken(spark, monkeypatch, leaf):
    docs = invented(random.Random(leaf), 1500, ["b", "a", None, "é", "Z", "𝔘", ""])
    rows = source_mixing.mix_sources(with_clashes(table(spark, docs)), leaf=leaf)
    rows = rows.selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken").collect()
    taken, want = check(rows, docs)
    assert any(0.01 < want[s] % 1 for s in want) and sum(abs(taken[s] - want[s]) for s in want) <= 0.02 * sum(want.values())


def test_reruns_agree_whatever_the_partitions(spark):
    docs = table(spark, invented(random.Random(3), 400, ["a", "b", "c"]))
    first, again = (sorted(source_mixing.op12(d).collect()) for d in (docs.repartition(2), docs.repartition(7)))
    assert first == again


def test_pairing_keeps_words_and_chances():
    r = np.random.default_rng(5)
    size, p = np.sort(r.integers(1, 60, 12))[::-1].copy(), r.uniform(0.05, 0.95, 12)
    total, n = np.zeros(12), 6000
    for k in range(n):
        out = source_mixing.paired(size, p, r.integers(-(2**62), 2**62, 12), 0)
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-6
        whole = source_mixing.paired(size, out, r.integers(-(2**62), 2**62, 12), 1, last=True)
        assert set(whole.tolist()) <= {0.0, 1.0}
        total += whole
    assert np.abs(total / n - p).max() < 5 * 0.5 / np.sqrt(n)


def test_awkward_texts_ids_and_the_empty_table(spark):
    rows = source_mixing.op12(with_clashes(documents(spark, AWKWARD))).collect()
    check(rows, [(i, t, "src0") for i, t in enumerate(AWKWARD)])
    base = [(None, "a b c", "x"), (None, None, None), (4, "d e", "x"), (4, "f g", "x"), (4, "f g", "x")]
    rows = source_mixing.op12(table(spark, base)).collect()
    assert sorted((r.size, r.source_size) for r in rows) == [(0, 0), (2, 9), (2, 9), (2, 9), (3, 9)]
    assert [r.target for r in rows if r.size == 0] == [0.0]
    empty = source_mixing.op12(table(spark, [])).collect()
    assert empty == []
    assert [r.taken for r in source_mixing.op12(documents(spark, ["", None])).collect()] == [0, 0]


def test_whole_table_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(source_mixing.query(spark, SF).collect(), docs)
