"""Importance resampling against a plain count of all features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import importance_resampling as resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").encode().translate(FOLD))
    return words, [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(texts, target, ids=None, percent=5, least=20):
    ids = list(range(len(texts))) if ids is None else ids
    found = [features(t) for t in texts]
    bucket = lambda f: zlib.crc32(f) % 10_000
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0))))
    rows = []
    for i, (words, fs) in zip(ids, found):
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in rows]


def got(rows):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=str)


MORE = [*AWKWARD, "É ABC abc-DEF 12x3", "w" * 200 + " a " + "y" * 65 + " b " + "z" * 64 + " c", "the cat sat on the mat " * 9, "\x00\x7f@[`{", "中文 字"]


def test_features_of_awkward_texts_and_of_the_head(spark):
    texts = [MORE[i % len(MORE)] for i in range(3 * len(MORE))] + [f"word{i} and the other words of text {i % 7} " * 4 for i in range(60)]
    target = ["the other words of", "mat 12x3 b", None, ""]
    rows = resampling.op11(with_clashes(documents(spark, texts)), with_clashes(documents(spark, target))).collect()
    assert got(rows) == sorted(brute(texts, target), key=str)
    assert sum(r["rank"] is not None for r in rows) == 3


def test_head_and_tail_give_the_same_buckets():
    texts = pa.array([t for t in MORE if t] * 3)
    rows = resampling.frequent_in(texts)
    side = lambda pair: {"hash": np.array([h for h, p in zip(rows["hash"].to_pylist(), rows["pair"].to_pylist()) if p == pair], np.int64).view(np.uint64)} | {
        k: np.array([x for x, p in zip(rows[k].to_pylist(), rows["pair"].to_pylist()) if p == pair], t) for k, t in (("crc", np.uint32), ("size", np.int64), ("n", np.int64))
    }
    head = resampling.Head(side(False), side(True))
    assert (head.tables[0][2] >= 0).sum() > 9 and (head.tables[1][2] >= 0).sum() > 9
    with_head, at = resampling.feature_buckets(texts, head)
    without, _ = resampling.feature_buckets(texts, resampling.Head())
    assert all((x == y).all() for x, y in zip(with_head, without))
    for n, t in enumerate(texts.to_pylist()):
        words, fs = features(t)
        want = [zlib.crc32(f) % 10_000 for f in fs]
        assert [x for run in with_head for x in run[at[n] : at[n + 1]].tolist() if x >= 0] == want


def test_ties_equal_and_missing_ids(spark):
    texts = ["same words here again " * 6] * 40 + ["a b " * 20, None]
    ids = [3] * 10 + [None] * 10 + [*range(100, 120), 3, None]
    rows = resampling.resample(documents(spark, texts, ids), documents(spark, ["same words"]), percent=50).collect()
    assert got(rows) == sorted(brute(texts, ["same words"], ids, percent=50), key=str)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert resampling.op11(empty, documents(spark, ["x"])).collect() == []
    texts = ["one two three"]
    assert got(resampling.op11(documents(spark, texts), empty).collect()) == brute(texts, [])


def test_whole_table_query(spark):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = resampling.query(spark, SF).collect()
    assert got(rows) == sorted(brute(list(table.values()), target, list(table)), key=str)
