"""Each stage of the pipeline on what the one before kept, against plain versions."""

import hashlib

import pytest
from helpers import AWKWARD, SF, documents
from test_decontamination import brute as leaks
from test_ngram_join import brute as groups
from test_suffix_dedup import brute as repeats
from test_tokens import packed, peer  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_one_by_one(spark, peer, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append(texts(docs) if n < 4 else {r.doc_id: r for r in docs.collect()})
    quality, near, suffix, leak, tokens = kept
    assert 0 < len(quality) < 200
    want = {i for i, _, g in groups(list(quality.values()), list(quality)) if i == g}
    assert near == {i: quality[i] for i in want | {i for i, t in quality.items() if not (t or "").split()}}
    digests = repeats(list(near.values()), 200)
    assert {i: len(t.encode()) for i, t in suffix.items() if "�" not in t} == {i: d[0] - d[1] for i, d in zip(near, digests) if "�" not in suffix[i]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {list(suffix)[d] for d, _ in leaks(list(suffix.values()), items)}
    assert set(leak) == set(suffix) - found
    for i, r in tokens.items():
        ids = peer.encode_ordinary(leak[i])
        assert r.n_tokens == len(ids) and bytes(r.ids) == packed(ids) and r.decoded_sha256 == hashlib.sha256(leak[i].encode()).hexdigest()
    assert set(tokens) == set(leak)


def test_rows_are_judged_one_by_one(spark):
    """Equal, missing and repeated ids, repeated rows, and columns with the names that stages use inside."""
    from helpers import with_clashes

    word = lambda i: f"w{i * 7919 % 9973}"
    base, clean = (" ".join(word(i) for i in range(a, a + 80)) for a in (0, 500))
    texts = [base, base + " x", clean, "short text", "short text", None, "", base, clean + " " + base[:30]]
    ids = [1, 5, 5, 3, 3, None, None, None, 9]
    docs = with_clashes(documents(spark, texts, ids)).selectExpr("*", "1 as _gone", "2 as _sd_k1", "3 as _qc0", "4 as _own0", "5 as _sd_found")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    assert rows == sorted([(1, base), (3, "short text"), (5, clean), (None, None), (None, "")], key=str)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert "_gone" in docs.columns and "_sd_found" in docs.columns
    assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count()


def test_awkward_rows_pass_through(spark):
    docs = documents(spark, AWKWARD, [None, *range(1, len(AWKWARD))])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, documents(spark, []), SF).count() == 0
