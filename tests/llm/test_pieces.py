"""Pieces of texts: where they are cut, how many the library gets at once, how many stay known."""

import random
import string

import pytest
from helpers import AWKWARD

from hazardloom.llm import byte_bpe, token_output

P = pytest.importorskip("public_tokenizers")
ODD = [" "] * 12 + ["\n"] * 8 + [",", "."] * 3 + [*byte_bpe.OTHER_BLANKS, *byte_bpe.WIDE_BLANKS, "᠎", "​", "﻿"]
ODD += ["\xe9", "\xd7", "\xf7", "ɏ", "中", "\U0001d518", "́", "\xbd", "\xb2", "\xaa", "א", "\xc3", "\x85", "\xa0", "\x00", "\x7f"]
ODD += ["'s", "'", "'re", "a", "the", "Word", "Z", "don", "12", "_", "-", "<|endoftext|>", "<|", "!?"]


def whole_file():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


class Counting:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def words(n):
    rng = random.Random(3)
    return ["".join(rng.choices(string.ascii_lowercase + "éß", k=9)) for _ in range(n)]


def test_new_words_reach_the_library_together():
    codec = byte_bpe.Codec.from_json(whole_file())
    text = ".\n".join(" ".join(words(9000)[i : i + 30]).capitalize() for i in range(0, 9000, 30))
    want = codec.tokenizer.encode(text, add_special_tokens=False).ids
    codec.tokenizer = Counting(codec.tokenizer)
    assert codec.encode([text, ""]) == [b"".join(i.to_bytes(4, "little") for i in want), b""]
    assert codec.tokenizer.texts < 20


@pytest.mark.parametrize("cached", [0, 40, byte_bpe.CACHED_PIECES])
def test_odd_texts_are_encoded_as_the_library_does_it(cached):
    """Blanks of all kinds, special strings, contractions, empty texts at both ends; pieces are forgotten and learned again."""
    rng, codec = random.Random(cached), byte_bpe.Codec.from_json(whole_file())
    codec.cached = cached
    for _ in range(8):
        texts = ["", *("".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(300)), *(t or "" for t in AWKWARD), ""]
        want = [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert codec.encode(texts) == [b"".join(i.to_bytes(4, "little") for i in x) for x in want]
        assert len(codec.known) <= cached


def test_pieces_that_stay_known_are_bounded():
    codec = byte_bpe.Codec.from_json(whole_file())
    codec.cached = 100
    for some in (words(5000)[:2500], words(5000)[2500:], ["x" * 60, "x" * 60 + " y"]):
        codec.encode([" ".join(some)])
        assert len(codec.known) <= 100 and all(len(p) <= byte_bpe.CACHED_LENGTH for p in codec.known)


def test_files_hold_texts_of_several_batches(spark):
    """Texts longer than a slice of a batch; each keeps its place and its end id."""
    from helpers import documents

    texts = [" ".join(words(300)) * n for n in (1, 0, 2000, 3, 0)]
    vocab = byte_bpe.vocabulary(spark, P.path("byte_bpe_50k.json"))
    rows = sorted(token_output.op8(documents(spark, texts), vocab, length=64).collect(), key=lambda r: r.doc_id)
    peer = byte_bpe.Codec.from_json(whole_file()).tokenizer
    sizes = [len(e.ids) + 1 for e in peer.encode_batch(texts, add_special_tokens=False)]
    assert [r.n_tokens for r in rows] == sizes and [r.start for r in rows] == [sum(sizes[:i]) for i in range(5)]


def test_the_index_is_written_by_the_tasks_and_names_whole_attempts_only(spark, tmp_path, monkeypatch):
    """One row a file reaches the driver, Spark itself writes no file; a file of an attempt that Spark did not take is passed over."""
    import shutil

    import pyarrow as pa
    import pyarrow.parquet as pq
    from helpers import documents
    from pyspark.sql.readwriter import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *_, **__: pytest.fail("a file for each task"))
    lost, folder = tmp_path / "out/index/ids-000000-999999.parquet", str(tmp_path / "out")
    lost.parent.mkdir(parents=True)
    pq.write_table(pa.Table.from_pylist([{"file": 0, "path": f"{folder}/ids-000000-999999.arrow", "doc_id": 1, "place": 0, "n_tokens": 9}], token_output.FIELDS), lost)
    shutil.copy(lost, lost.parent / "_begun.parquet")
    index = token_output.write(documents(spark, words(500)), byte_bpe.vocabulary(spark, P.path("byte_bpe_50k.json")), folder)
    assert spark.read.schema(token_output.INDEX).parquet(f"{folder}/index").count() == 501
    rows = index.collect()
    assert sorted(r.doc_id for r in rows) == list(range(500))
    assert {r.path for r in rows} == {str(p) for p in (tmp_path / "out").glob("*.arrow")}


def test_ids_are_read_back_in_parts(spark, monkeypatch):
    """Batches of rows with many ids are cut; an empty text and a long one keep their rows."""
    from helpers import documents

    texts = ["", *(" ".join(words(40)) for _ in range(30)), " ".join(words(3000)), ""]
    vocab = byte_bpe.vocabulary(spark, P.path("byte_bpe_50k.json"))
    want = sorted(token_output.op8(documents(spark, texts), vocab, length=64).collect())
    monkeypatch.setattr(token_output, "READ_IDS", 500)
    assert sorted(token_output.op8(documents(spark, texts), vocab, length=64).collect()) == want and len(want) == 33
