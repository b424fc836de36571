"""License scan: exact phrases, and short notices with a bounded number of errors.

Base places are runs of consecutive words that spell a phrase. Notices may be misspelt: a notice that occurs with k
edits at most has one of its k + 1 pieces unchanged, so plain substring searches for the pieces (seeds) locate
candidates, and the regex library's bounded-error matching verifies the stretch around a seed, counts the edits and
reports the span.

Defined results: a null or empty text has no words, places or labels and scores 0; matches of a notice
don't overlap, and each is the one with the fewest edits where it stands; rows with equal ids stay separate; a null doc_id stays null; an empty table
gives an empty one; other columns are neither read nor returned."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hazardloom.llm.common import load, mapped, slices, text_bytes, texts_of

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("creative commons zero public domain dedication", "cc0"),
    ("all rights reserved", "reserved"),
)
ERROR_SHARE = 10  # one edit for so many characters
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if WORD[b] else 32 for b in range(256))
_ASIDE = 24  # bytes around a seed, beyond the notice, in which a match may begin and end


def phrase_places(text: bytes, phrase: bytes) -> list[int]:
    """Byte places of a phrase in a text whose words are folded and stand between blanks."""
    words = phrase.split()
    found = []
    rare = max(words, key=len)
    if rare in text:
        pattern = re.compile(rb"(?<![^ ])(?=" + rb" +".join(map(re.escape, words)) + rb"(?![^ ]))")
        found = [m.start() for m in pattern.finditer(text)]
    return found


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    errors: int
    seeds: tuple[tuple[bytes, int], ...]
    pattern: object

    @classmethod
    def of(cls, text: str, label: str) -> Notice:
        import regex

        data = text.encode()
        k = len(data) // ERROR_SHARE
        edges = [len(data) * i // (k + 1) for i in range(k + 2)]
        seeds = tuple((data[a:b], a) for a, b in zip(edges[:-1], edges[1:], strict=True))
        return cls(data, label, k, seeds, regex.compile(rb"(?<![^ ])(?e)(?:%s){e<=%d}(?![^ ])" % (regex.escape(data, special_only=True), k)))

    def candidates(self, text: bytes) -> list[tuple[int, int]]:
        """Stretches of text around the seeds, joined where they overlap."""
        spots = set()
        for seed, place in self.seeds:
            at = text.find(seed)
            while at >= 0:
                spots.add(max(0, at - place))
                at = text.find(seed, at + 1)
        out: list[list[int]] = []
        for spot in sorted(spots):
            a, b = max(0, spot - self.errors - _ASIDE), spot + len(self.text) + self.errors + _ASIDE
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [(a, min(len(text), b)) for a, b in out]

    def places(self, text: bytes) -> list[tuple[int, int, int]]:
        """Begin, end and edits of each match."""
        return [(m.start(), m.end(), sum(m.fuzzy_counts)) for a, b in self.candidates(text) for m in self.pattern.finditer(text, a, b)]


def squeezed(text: bytes) -> bytes:
    """The folded words with one blank between them."""
    return b" ".join(text.translate(_FOLD).split())


SCHEMA = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "spans": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])),
}
_SQL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, edits: int>>"


def scan_text(text: bytes, phrases, notices: list[Notice]) -> tuple:
    """Base places (as word numbers), labels and the notices' spans of one squeezed text."""
    found = [(p, label) for phrase, label in phrases for p in phrase_places(text, phrase)]
    near = [(n, *place) for n in notices for place in n.places(text)]
    if not found and not near:
        return 0, None, None, "", "", 0.0, []
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    at_word = lambda place: int(np.searchsorted(blanks, place))
    base = [(at_word(p), label) for p, label in found]
    spans = [(n.label, at_word(a), at_word(b) + 1, edits, 1 - edits / len(n.text)) for n, a, b, edits in near]
    starts = [w for w, _ in base]
    own = sorted({label for _, label in base})
    labels = sorted({*own, *(s[0] for s in spans)})
    score = max([1.0] * bool(base) + [s[4] for s in spans] + [0.0])
    return len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(labels), score, [dict(zip(("label", "first_word", "end_word", "edits"), s, strict=False)) for s in sorted(spans)]


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per row the contract's columns, and `spans`: label, first word, word after the last, and edits of each notice."""

    def run(batches):
        plain = [(phrase.encode(), label) for phrase, label in phrases]
        known = [Notice.of(text, label) for text, label in notices]
        for whole in batches:
            for b in slices(whole, "text"):
                data, bounds = text_bytes(b.column("text"))
                raw = data.tobytes()
                inside = WORD[data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                edges = bounds[1:-1][bounds[1:-1] < len(data)]
                first[edges] = inside[edges]
                counts = np.diff(np.concatenate([[0], np.cumsum(first)])[bounds])
                rows = [scan_text(squeezed(raw[i:j]), plain, known) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(list(SCHEMA.values())[2:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts.astype(np.int64)), *made], list(SCHEMA))

    return mapped(texts_of(docs), run, _SQL)


def op10(docs: DataFrame) -> DataFrame:
    return scan(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(load(spark, sf_dir, "documents"))
