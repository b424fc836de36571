"""Base places by plain word search; misspelt notices; the awkward cases."""

import re

from helpers import AWKWARD, SF, documents, with_clashes

from hazardloom.llm import license_scan as ls

NOT_WORD = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = [w for w in NOT_WORD.split((text or "").encode().lower()) if w]
    places = []
    for phrase, label in ls.PHRASES:
        p = phrase.encode().split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "All Rights  Reserved. all rights-reserved ALL\nRIGHTS\tRESERVED", "xall rights reserved", "all rights reservedé", "CC-BY cc by 4.0 (cc:by)", "ccby cc_by", "GNU General Public License, version 3",
    "general public general public license license", "Released under the MIT License.", "Relesed undr the MIT Licence", "Licensed under the Apache Lisence, Version 2.0", "é general public license ü", "cc by" * 3, "cc " * 5 + "by",
]


def test_base_places(spark):
    texts = [*TEXTS, *AWKWARD]
    rows = ls.op10(with_clashes(documents(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id][:60]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_whole_table_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = ls.query(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: brute(t) for i, t in texts.items()}


def test_misspelt_notices_and_spans():
    notices = [ls.Notice.of(t, n) for t, n in ls.NOTICES]
    got = lambda t: ls.scan_text(ls.squeezed(t.encode()), [], notices)
    for text, label, edits in [("some words. Relased under the MIT Licence here", "mit", 2), ("licensed under the apache lisense, version 2.0!", "apache-2.0", 2), ("x all rigts reserved y", "reserved", 1)]:
        assert label in got(text)[4].split(","), text
        assert any(s["label"] == label and s["edits"] <= edits for s in got(text)[6])
    span = [s for s in got("one two released under the mit license three")[6] if s["edits"] == 0]
    assert span == [{"label": "mit", "first_word": 2, "end_word": 7, "edits": 0}]
    for text in ["plain prose about the licence of poets", "under the bridge all the rights were left", "general purpose public works"]:
        assert got(text)[4] == "", text


def test_every_seed_split_finds_its_notice():
    import random

    r = random.Random(4)
    for text, label in ls.NOTICES:
        n = ls.Notice.of(text, label)
        assert len(n.seeds) == n.errors + 1 and b"".join(s for s, _ in n.seeds) == n.text
        for _ in range(20):
            t = bytearray(n.text)
            for _ in range(n.errors):
                t[r.randrange(len(t))] = ord("q")
            assert n.places(b"before " + bytes(t) + b" after"), bytes(t)


def test_many_places_in_a_long_text():
    import time

    notices = [ls.Notice.of(t, n) for t, n in ls.NOTICES]
    began = time.time()
    out = ls.scan_text(ls.squeezed(b"All rights reserved. Released under the MIT License. " * 5000), [(p.encode(), n) for p, n in ls.PHRASES], notices)
    assert out[:3] == (5000, 0, 8 * 4999) and time.time() - began < 60


def test_empty_table(spark):
    assert ls.op10(documents(spark, [])).collect() == []
