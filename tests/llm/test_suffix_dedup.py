"""Repeated byte strings against a count of all windows."""

import hashlib
import random
from collections import Counter

from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_planted_repeats(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60), prose(90), prose(45)]
    texts = [prose(40) + r.choice(shared) + prose(30) + r.choice(["", r.choice(shared)]) for _ in range(60)]
    base = prose(300)
    texts += [base[: 50 * i] + "#" + base[50 * i + 1 :] for i in range(12)] + [base, base]
    texts += ["ab" * 400, "z" * 1000, "z" * 199, "z" * 200, prose(30) + "q" * 450, prose(8)]
    texts += [shared[0].encode()[:199].decode(errors="ignore"), shared[1][7:], *AWKWARD]
    rows = suffix_dedup.op7(with_clashes(documents(spark, texts))).collect()
    assert len(rows) == len(texts)
    want = brute(texts, 200)
    assert got(rows) == dict(enumerate(want))


def test_other_lengths_and_tiny_bitmap(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 120))) for _ in range(80)]
    for length, gram, digit, bits in [(12, 5, 5, 16), (20, 20, 7, 12), (30, 8, 30, 10)]:
        rows = suffix_dedup.remove(documents(spark, texts), length, gram=gram, digit=digit, bits=bits).collect()
        assert [(x["_sd_n_bytes"], x["_sd_n_removed"], x["_sd_n_spans"], x["_sd_kept_sha256"]) for x in sorted(rows, key=lambda x: x.doc_id)] == brute(texts, length)


def test_rows_with_equal_or_no_ids(spark):
    a, b = "once " * 60, "".join(chr(97 + i % 26) + str(i) for i in range(150))
    rows = suffix_dedup.op7(documents(spark, [b, b, a, None, b + "x"], [None, 7, 7, None, 7])).collect()
    want = sorted(brute([b, b, a, None, b + "x"], 200))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    twice = suffix_dedup.op7(documents(spark, [b, b], [1, 1])).collect()
    assert [r.n_removed for r in twice] == [len(b)] * 2


def test_whole_table_query_and_cleaning(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in table.orderBy("doc_id").collect()]
    found = got(suffix_dedup.query(spark, SF).collect())
    assert [found[i] for i in range(len(texts))] == brute(texts, 200)
    clean = suffix_dedup.cleaned(table)
    assert clean.columns == table.columns and clean.count() == len(texts)


def test_empty_table(spark):
    assert suffix_dedup.op7(documents(spark, [])).collect() == []


def test_cleaned_texts_have_whole_characters_and_any_column_names(spark):
    shared = "".join(chr(0x4E00 + i * 7 % 900) for i in range(90))
    texts = ["é" + shared + "ü", "a" + shared + "z", shared.replace(shared[3], "x", 1) + "ö", None, "", "kept \ufffd as it is"]
    docs = with_clashes(documents(spark, texts)).selectExpr("*", "1 as _sd_k1", "2 as _sd_kept", "3 as _sd_found", "4 as c0", "5 as _text")
    rows = suffix_dedup.cleaned(docs)
    assert rows.columns == docs.columns
    got = {r.doc_id: r.text for r in rows.collect()}
    assert got[3] is None and got[4] == "" and got[5] == texts[5]
    # the first byte of the last letter repeats, with the passage before it, in two texts: what is left of the letter goes too
    assert got[0] == "é" and got[1] == "az" and "\ufffd" not in "".join(got[i] for i in range(3))
