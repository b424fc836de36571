"""Language identification of texts that may mix languages.

Training counts letter n-grams (words padded by a blank, bytes of UTF-8, A-Z folded) of each language in
a table of 2**BITS cells; tasks add up their own tables first. A document is then a mixture: expectation
maximisation finds the language shares that make its n-grams likeliest, over nested sets of languages (the
largest shares first), and the set with the best likelihood less a penalty per language is taken.

A task sends one table per language it has, whatever its rows; tables are summed in slices, so a language that
holds most rows is no larger than another.

Defined results: a null text, or one without a letter, is `und` with score 0 and no shares; without training
rows every text is `und`; ties go to the language first in alphabetical order; rows with equal ids stay separate;
a null doc_id counts as empty text in the choice of held-out rows; an empty table gives an empty one; other columns
are neither read nor returned."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.common import load, mapped, mix, slices, text_bytes, texts_of

ORDERS = (2, 3, 4)
BITS = 16
SLICES = 16
ROUNDS = 12
PENALTY = 3.0  # per language, times the log of the number of n-grams
SMOOTHING = 0.5
UNKNOWN = "und"
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def cells(data: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Cells of all letter n-grams of a text: non-letters of ASCII are one blank, and n-grams hold one at most at an end."""
    b = _FOLDED[data]
    b = np.concatenate([[32], b, [32]]).astype(np.uint8)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    blank = b == 32
    wide = b.astype(np.uint64)
    out = []
    for n in orders:
        m = len(b) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i : i + m]
            if 0 < i < n - 1:
                inner |= blank[i : i + m]
        out.append(code[~inner & ~(blank[:m] & blank[n - 1 :])])
    codes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return (mix(codes) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Languages in alphabetical order, and per cell the probability in each."""

    languages: list[str]
    table: np.ndarray
    bits: int

    def mixture(self, found: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of all languages for the cells of a text, and the penalised log likelihood."""
        seen = np.bincount(found, minlength=1 << self.bits)
        spots = np.flatnonzero(seen)
        counts = seen[spots].astype(float)
        p = self.table[spots]
        total = counts.sum()

        def maximise(p, shares):
            for _ in range(ROUNDS if len(shares) > 1 else 0):
                shares = shares * ((counts / (p @ shares)) @ p) / total
            return shares, float(counts @ np.log(p @ shares))

        n = len(self.languages)
        whole, _ = maximise(p, np.full(n, 1.0 / n))
        order = np.argsort(-whole, kind="stable")
        best, best_value = None, -np.inf
        for k in range(1, n + 1):
            chosen = order[:k]
            own, value = maximise(np.ascontiguousarray(p[:, chosen]), whole[chosen] / whole[chosen].sum())
            value -= PENALTY * k * np.log(max(2.0, total))
            if value <= best_value:
                break
            shares = np.zeros(n)
            shares[chosen] = own
            best, best_value = shares, value
        return best, best_value


def fit(docs: DataFrame, language: str = "lang", bits: int = BITS) -> Model:
    """The model of all rows that have a text with letters and a language."""
    rows = texts_of(docs.where(F.col(language).isNotNull()), F.col(language).alias("language"))
    size = (1 << bits) // SLICES

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                data, bounds = text_bytes(b.column("text"))
                for name, i, j in zip(b.column("language").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if name not in sums:
                        sums[name] = np.zeros(1 << bits, np.int64)
                    sums[name] += np.bincount(cells(data[i:j], bits), minlength=1 << bits)
        for name, table in sums.items():
            parts = [table[s * size : (s + 1) * size].astype("<i8").tobytes() for s in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array(parts)], ["language", "slice", "counts"])

    def total(batches: pa.Table) -> pa.Table:
        whole = np.zeros(size, np.int64)
        for x in batches.column("counts").to_pylist():
            whole += np.frombuffer(x, "<i8")
        return pa.table({"language": batches.column("language")[:1], "slice": batches.column("slice")[:1], "counts": pa.array([whole.astype("<i8").tobytes()])})

    shape = "language string, slice int, counts binary"
    parts = mapped(rows, count, shape).groupBy("language", "slice").applyInArrow(total, shape).collect()
    names = sorted({r.language for r in parts})
    sums = np.zeros((1 << bits, len(names)))
    for r in parts:
        sums[r.slice * size : (r.slice + 1) * size, names.index(r.language)] = np.frombuffer(r.counts, "<i8")
    known = [i for i in range(len(names)) if sums[:, i].sum() > 0]
    sums = sums[:, known] + SMOOTHING
    return Model([names[i] for i in known], sums / sums.sum(0, keepdims=True), bits)


def identify(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """Per row: doc_id, the columns asked for, lang_pred, score (its share), languages and shares of the chosen set, largest first."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts_of(docs, *more, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    extra = [f for f in rows.schema.fields if f.name not in ("doc_id", "text", "lettered")]

    def run(batches):
        model = sent.value
        for whole in batches:
            for b in slices(whole, "text"):
                data, bounds = text_bytes(b.column("text"))
                out = []
                for lettered, i, j in zip(b.column("lettered").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    found = cells(data[i:j], model.bits) if lettered and model.languages else ()
                    if not len(found):
                        out.append((UNKNOWN, 0.0, [], []) if not lettered or not model.languages else (model.languages[0], 1.0 / len(model.languages), [], []))
                        continue
                    shares, _ = model.mixture(found)
                    order = [k for k in np.argsort(-shares, kind="stable") if shares[k] > 0]
                    out.append((model.languages[order[0]], float(min(1.0, shares[order[0]])), [model.languages[k] for k in order], [float(shares[k]) for k in order]))
                kinds = {"lang_pred": pa.string(), "score": pa.float64(), "languages": pa.list_(pa.string()), "shares": pa.list_(pa.float64())}
                made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(f.name) for f in extra], *made], ["doc_id", *[f.name for f in extra], *kinds])

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in extra)
    return mapped(rows, run, f"doc_id long, {shape}lang_pred string, score double, languages array<string>, shares array<double>")


def held_out_column() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op9(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs.where(~held_out_column())), held_out_column().alias("held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(load(spark, sf_dir, "documents"))
