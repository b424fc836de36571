"""Counts and base scores by brute force; the filter and the smoothed scores against exact counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import lm_scoring as lm


def words(text):
    return [*(text or "").encode().lower().split(), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows):
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        ws = words(t)
        out.append((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)))
    return out


def check(rows, want):
    order = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_base_scores_and_counts(spark):
    texts = [*AWKWARD, *[f"the cat {i} sat on the mat" for i in range(40)]]
    ids = [*range(len(texts) - 2), None, 3]
    check(lm.op1(with_clashes(documents(spark, texts, ids))).collect(), brute(list(zip(ids, texts))))


def test_rare_words_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    texts = [" ".join(random.Random(i).choices([f"w{j}" for j in range(200)], k=60)) for i in range(30)]
    check(lm.op1(documents(spark, texts)).collect(), brute(list(enumerate(texts))))


def test_whole_table_and_gain_over_single_words(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = lm.query(spark, SF).collect()
    check(found, brute(rows))
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_filter_gives_back_levels():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**64, 20_000, dtype=np.uint64)
    counts = np.minimum(r.zipf(1.4, len(keys)), 10**9)
    levels = lm.level_of(counts, 1)
    bucket = (keys >> np.uint64(59)).astype(int)
    segments = [(b, *lm.Filter.build(keys[bucket == b], levels[bucket == b])) for b in range(32)]
    built = lm.Filter.join(segments, 32, 1)
    got = built.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    assert (built.levels(r.integers(0, 2**64, 20_000, dtype=np.uint64)) > 0).mean() < 0.03
    exact = levels
    assert (built.least(exact) <= counts).all() and (built.most(exact) >= counts).all()


def test_probabilities_sum_to_one_at_most(spark):
    texts = [" ".join(random.Random(i).choices("a b c d e f".split(), [9, 5, 3, 2, 1, 1], k=30)) for i in range(40)]
    model, _ = lm.fit(documents(spark, texts))
    tokens = {}
    for w in ["a", "b", "c", "d", "e", "f", None]:
        t, b = lm.tokens_of(pa.array([f"a {w}" if w else "a"]))
        tokens[w] = 10 ** model.token_scores(t, b)[1]
    assert 0.8 < sum(tokens.values()) < 1.05


def test_empty_table_and_no_training_rows(spark):
    assert lm.op1(documents(spark, [])).collect() == []
    ids = [i for i in range(60) if held(i)][:3]
    rows = lm.op1(documents(spark, ["a b", "c", None], ids)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0)] * 3


def plain_scores(rows):
    """Pair scores from exact counts, quantised as stated; no filter, so nothing false."""
    single, pairs, texts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            ws = words(t)
            single.update(ws)
            pairs.update(zip(["begin", *ws], ws))
            texts += 1
    n, v = sum(single.values()), len(single)
    level = lambda c: int(lm.level_of(np.array([c]), 1)[0])
    least = lambda c: int(lm.LEVELS[level(c) - 1]) if c else 0
    most = lambda c: int(lm.LEVELS[level(c)]) - 1
    out = {}
    for i, t in rows:
        ws = words(t)
        out[i] = 0.0
        for k, w in enumerate(ws):
            context = most(single[ws[k - 1]]) if k else texts
            seen = pairs[ws[k - 1] if k else "begin", w]
            out[i] += math.log10((least(seen) + lm.WEIGHT * (least(single[w]) + 1) / (n + v + 1)) / (context + lm.WEIGHT))
    return out


@pytest.mark.parametrize("room", [1 << 20, 400])
def test_no_gram_is_dropped_whatever_the_size(spark, monkeypatch, room):
    """Every pair counts, those seen once too, however little may be sent at a time."""
    monkeypatch.setattr(lm, "ENTRIES", (64, 64), raising=False)
    monkeypatch.setattr(lm, "ROUND_BYTES", room, raising=False)
    texts = [" ".join(random.Random(i).choices([f"w{j}" for j in range(40)], k=30)) for i in range(30)]
    want = plain_scores(list(enumerate(texts)))
    rows = lm.op1(documents(spark, [*texts, texts[0]], [*range(30), 300])).collect()
    assert len(rows) == 31 and {r.score for r in rows if r.doc_id == 300} == {r.score for r in rows if r.doc_id == 0}
    gaps = [abs(r.score - want[r.doc_id]) / r.n_tokens for r in rows if r.doc_id != 300]
    assert sum(gaps) / len(gaps) < 0.01, sum(gaps) / len(gaps)
