"""Encoding, decoding and the sequence files against the tokenizer libraries themselves."""

import base64
import hashlib
import struct
import zlib

import pytest
from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import byte_bpe, token_output

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def rank_vocab(spark):
    return byte_bpe.vocabulary(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def json_vocab(spark):
    return byte_bpe.vocabulary(spark, P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


SPACES = ["a<|endoftext|>b", " lead", "trail ", "a \n b", "x\x0b y", "z\xa0 w", "don't  we'll", "é 　中文字 ½²", "tab\tbed \r\n"]


def test_digests_are_those_of_the_other_library(spark, rank_vocab, peer):
    texts = AWKWARD + SPACES
    rows = byte_bpe.op4(with_clashes(documents(spark, texts)), rank_vocab).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = peer.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_whole_table_query(spark, peer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = byte_bpe.query(spark, SF).collect()
    assert {r.doc_id: r.ids_sha256 for r in rows} == {i: hashlib.sha256(packed(peer.encode_ordinary(t))).hexdigest() for i, t in texts.items()}


def test_offsets_and_split_characters(spark, rank_vocab):
    codec = byte_bpe.codec_of(rank_vocab)
    for text in ["plain words", "𝔘☃é中", "mixed 𝔘 and ☃"]:
        ids = codec.encode([text])[0]
        assert "".join(codec.token_texts(ids)) == text
        spans = codec.character_spans(ids, text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b[0] in (a[1], a[1] - 1) for a, b in zip(spans, spans[1:]))
    got = byte_bpe.encode(documents(spark, ["𝔘☃"]), rank_vocab, offsets=True).first()
    assert got.spans[0][0] == 0 and got.spans[-1][1] == 2 and len(got.spans) > 2


def test_empty_tables(spark, rank_vocab, json_vocab):
    assert byte_bpe.op4(documents(spark, []), rank_vocab).collect() == []
    assert token_output.op8(documents(spark, []), json_vocab).collect() == []


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_files_hold_all_ids_in_order(spark, json_vocab):
    texts = AWKWARD + SPACES + ["one <|endoftext|> two.<|endoftext|>", "<|endoftext|>"]
    peer = library()
    ids = [*range(100, 100 + len(texts) - 3), None, 100, 100]
    rows = token_output.op8(with_clashes(documents(spark, texts, ids)), json_vocab, length=64).collect()
    whole, want = 0, []
    for i, t in sorted(zip(ids, [t or "" for t in texts]), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        tokens = [*peer.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, whole, len(tokens), zlib.crc32(packed(tokens))))
        whole += len(tokens)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == want


def test_a_special_string_is_read_as_the_library_reads_it(spark, json_vocab):
    row = token_output.op8(documents(spark, ["a<|endoftext|>b"]), json_vocab).first()
    assert (row.n_tokens, row.ids_crc32) == (4, zlib.crc32(packed([64, 50256, 65, 0])))


def test_sequences_and_masks(spark, json_vocab, tmp_path):
    index = token_output.write(documents(spark, ["some words here"] * 40), json_vocab, str(tmp_path / "out"), length=16)
    total = 0
    for path in {r.path for r in index.collect()}:
        reader = token_output.Reader(path)
        n = sum(reader.file.get_batch(i).num_rows for i in range(reader.file.num_record_batches))
        parts = [reader.sequence(i) for i in range(n)]
        assert all(len(a) == len(m) == 16 for a, m in parts)
        total += sum(int(m.sum()) for _, m in parts)
    assert total == sum(r.n_tokens for r in index.collect())
