"""Scores with a filter that is too large to be sent to workers: questions go to its places."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, with_clashes
from test_lm_scoring import brute, check, held

from hazardloom.llm import lm_scoring as lm


def some_texts(n=60, words=300, seed=7):
    r = random.Random(seed)
    return [" ".join(r.choices([f"w{j}" for j in range(words)], [1 / (j + 1) for j in range(words)], k=r.randrange(1, 80))) for _ in range(n)]


def counted(monkeypatch, rows, room):
    """Tables that a query stores, and how many parts a filter of that room has."""
    monkeypatch.setattr(lm, "ROUND_BYTES", room)
    names, plain = [], lm.staged

    def staged(df, name):
        names.append(name)
        return plain(df, name)

    with monkeypatch.context() as m:
        m.setattr(lm, "staged", staged)
        lm.op1(rows).collect()
    return names, lm.fit(rows.where(~lm.held_out_column()))[0].rounds()


def test_texts_are_not_read_again_for_each_part_of_the_filter(spark, monkeypatch):
    rows = documents(spark, some_texts())
    (few, a), (many, b) = (counted(monkeypatch, rows, room) for room in (3000, 2000))
    assert 1 < a < b and few == many


@pytest.mark.parametrize("order", [1, 2])
@pytest.mark.parametrize("flush", [200, 1 << 22])
def test_scores_are_those_of_the_whole_filter(spark, monkeypatch, order, flush):
    monkeypatch.setattr(lm, "FREQUENT", 40)  # so that words are looked up at their places too
    monkeypatch.setattr(lm, "FLUSH", flush)
    texts = [*some_texts(), *AWKWARD, "of words never seen before", "of words never seen before", "never never never"]
    hold = [i for i in range(2000) if held(i)]
    ids = [*range(len(texts) - 6), None, 3, 3, hold[-1], hold[-2], hold[-3]]
    rows = with_clashes(documents(spark, texts, ids))
    model, words = lm.fit(rows.where(~lm.held_out_column()), order)
    monkeypatch.setattr(lm, "ROUND_BYTES", 100)
    small, _ = lm.fit(rows.where(~lm.held_out_column()), order)
    assert model.rounds() == 1 < small.rounds() and 0 < len(small.frequent) < small.v
    got = lm.op1(rows, order).collect()
    check(got, brute(list(zip(ids, texts, strict=True))))
    tokens, bounds = lm.tokens_of(pa.array(texts, pa.string()))
    want = np.add.reduceat(model.token_scores(tokens, bounds), bounds[:-1])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    pairs = zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(zip(ids, want.tolist(), strict=True), key=key), strict=True)
    assert all(g[0] == w[0] and math.isclose(g[1], w[1], rel_tol=1e-9) for g, w in pairs)
    assert len({r.score for r in got if r.doc_id in hold[-2:]}) == 1


def test_dealt_without_training_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "ROUND_BYTES", 0)
    ids = [i for i in range(60) if held(i)][:3]
    rows = documents(spark, ["a b", "c", None], ids)
    model, words = lm.fit(rows.where(~lm.held_out_column()))
    got = lm.dealt(rows, model, words).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(ids[0], 3, 0, 0, 0.0), (ids[1], 2, 0, 0, 0.0), (ids[2], 1, 0, 0, 0.0)]
    assert lm.dealt(documents(spark, []), model, words).collect() == []


def test_planes_give_numbers_back():
    for kind in ("<u2", "<u4", "<u8", "<i8"):
        for n in (0, 1, 1000):
            x = np.random.default_rng(n).integers(0, 60_000, n).astype(kind)
            assert (lm.from_planes(lm.planes(x), kind) == x).all()
