"""Alignment of two tokenizers against whole-text encodings by the libraries themselves."""

import hashlib
from collections import Counter

import pytest
from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import token_alignment

P = pytest.importorskip("public_tokenizers")
TEXTS = [*AWKWARD, "a<|endoftext|>b", " lead", "trail ", "a \n b", "x\x0b y", "z\xa0 w", "don't  we'll", "é 　中文字 ½²", "tab\tbed \r\n", "in▁side and out", "<0x41> <s> </s>", "𝔘☃é中 𝔘𝔘 ☃☃", "a\x00b", "the cat the cat sat, the mat. sat,, mat.. é. 中, ², 5. a.b. ﬁ, ", "́combining é ﬁ ligature"]


@pytest.fixture(scope="module")
def sources(spark):
    return token_alignment.vocabularies(spark, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def peers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def brute(texts, peers):
    a, b = peers
    table = byte_alphabet()
    rows, pairs = [], Counter()
    for text in texts:
        whole = b"" if not text else (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                at += len(p)
                out.append(at)
            ends.append(out)
        links = [(x, y) for x, e in zip(ids_a, ends[0]) for y, f in zip(ids_b, ends[1]) if e == f] if len(ids_a) < 3000 else [(x, ids_b[ends[1].index(e)]) for x, e in zip(ids_a, ends[0]) if e in set(ends[1])]
        pairs.update(links)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(ids_a, ends[0]) if low < e <= c) + "|" + ",".join(str(y) for y, e in zip(ids_b, ends[1]) if low < e <= c))
            low = c
        rows.append((len(ids_a), len(ids_b), len(cuts), links, ";".join(groups)))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return [(na, nb, g, len(ls), sum(pairs[x] == best[x[1]] for x in ls), sum(pairs[x] for x in ls), hashlib.sha256(s.encode()).hexdigest() if s else "") for na, nb, g, ls, s in rows]


def got(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]


SHORT = [t if t is None or len(t) < 9000 else t[:4000] for t in TEXTS]


def test_awkward_texts(spark, sources, peers):
    want = brute(SHORT, peers)
    assert got(token_alignment.op13(with_clashes(documents(spark, SHORT)), sources).collect()) == want
    assert sum(w[0] == 0 for w in want) >= 3 and sum(w[0] > w[2] > 0 for w in want) >= 3


def test_very_long_texts(spark, sources, peers):
    texts = ["x" * 30_000, "word " * 20_000, "中" * 5_000]
    rows = {r.doc_id: r for r in token_alignment.op13(documents(spark, texts), sources).collect()}
    for i, t in enumerate(texts):
        assert rows[i].n_a == len(peers[0].encode(" " + t, add_special_tokens=False).ids) and rows[i].n_b == len(peers[1].encode(t))


def test_pairs_outside_the_head_are_joined(spark, sources, peers):
    """With a head of few pairs nearly all links are looked up in the join."""
    texts = SHORT * 2
    from pyspark.sql import functions as F

    rows = token_alignment.alignment(documents(spark, texts), sources, head_pairs=5, groups=True)
    shown = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    assert got(rows.withColumn("n_groups", F.col("n_links")).collect()) == brute(texts, peers) and rows.where(shown != F.col("groups_sha256")).isEmpty()


def test_whole_table_query(spark, peers):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = token_alignment.query(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(table)
    some = {i: t for i, t in table.items() if len(t) < 4000}
    want = dict(zip(table, brute_counts(table, peers)))
    assert {r.doc_id: (r.n_a, r.n_b) for r in rows} == want and some


def brute_counts(table, peers):
    a, b = peers
    return [(len(a.encode(" " + t, add_special_tokens=False).ids), len(b.encode(t))) if t else (0, 0) for t in table.values()]


def test_equal_and_missing_ids_and_the_empty_table(spark, sources, peers):
    texts = ["one two", "one two", "three", None]
    rows = token_alignment.op13(documents(spark, texts, [7, 7, None, None]), sources).collect()
    want = brute(texts, peers)
    assert sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == sorted(want)
    assert token_alignment.op13(documents(spark, []), sources).collect() == []


def test_a_vocabulary_whose_pieces_span_blanks_is_not_cut(spark, sources, peers):
    aligner = token_alignment.Aligner(*(s.value for s in sources))
    texts = ["plain words here", "é𝔘 ☃ x", "  two  blanks "]
    cut = aligner.texts(texts)
    assert aligner.cuts
    aligner.forget(0)
    aligner.cuts = False
    whole = aligner.texts(texts)
    assert (cut[0] == whole[0]).all() and cut[1:] == whole[1:]


def test_a_small_cache_changes_nothing(sources, monkeypatch):
    aligner = token_alignment.Aligner(*(s.value for s in sources))
    texts = [t for t in SHORT if t] * 2
    want = aligner.texts(texts)
    monkeypatch.setattr(token_alignment, "CACHED", 6)
    monkeypatch.setattr(token_alignment, "LEARNED_AT_ONCE", 3)
    aligner.forget(0)
    parts = [aligner.texts(texts[n : n + 4]) for n in range(0, len(texts), 4)]
    assert len(aligner.slot) <= 6 and len(aligner.slot) == len(aligner.groups) == len(aligner.numbers[0])
    assert [g for p in parts for g in p[1]] == want[1] and [x for p in parts for x in p[2]] == want[2]
