"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration.

Statistics of the text (lengths, shares of character classes, repetition) are standardised and mapped to random cosine
features, whose inner products approximate a Gaussian kernel. Each task sums the normal equations of its labelled
rows; the sums, whose size depends on the number of features alone, are added up in slices and solved once. Labelled rows of
another fold calibrate: their raw scores are counted in narrow bins, and pool-adjacent-violators over the bins gives a rising
step function, read with interpolation.

Defined results: a null or empty text has the statistics of no words and gets a score like any other; a label other
than 0 or 1 or null is no label; labels without a document are ignored, a document with several labels counts once for
each; without labelled rows every score is 0.5; with one calibration class only, the score is that class's; rows with
equal ids stay separate; a null doc_id has no label and counts as empty text in the choice of held-out rows; an empty table
gives an empty one. `filtered` keeps all columns, whatever their names; `score` returns none of them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.common import free_names, joined_hashes, load, mapped, slices, span_hashes, staged, text_bytes, text_key, texts_of, word_spans

FEATURES = 256
GAMMA = 0.03
RIDGE = 1.0
THRESHOLD = 0.3
BINS = 1000  # calibration bins per unit of raw score
SLICES = 16

# The character classes counted.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "line": b"\n", "symbol": b"#*$%&<>@^~", "bar": b"|", "shout": b"!?", "stop": b".,;:", "quote": b"\"'()[]{}", "wide": bytes(range(128, 256))}
_CLASS = np.zeros(256, np.uint8)
for _n, _chars in enumerate(CLASSES.values(), 1):
    _CLASS[list(_chars)] = _n
STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", *CLASSES, "distinct", "top_word", "same_as_before", "repeated_windows", "duplicate_lines", "short_words", "capitalised",
]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; shares are of bytes, words or lines."""
    data, bounds = text_bytes(column)
    starts, ends, at = word_spans(data, bounds)
    words, sizes = span_hashes(data, starts, ends), ends - starts
    windows = joined_hashes(words, 3)
    firsts = _CLASS[data[starts]] == 2
    breaks = np.zeros(256, bool)
    breaks[10] = True
    line_starts, line_ends, line_at = word_spans(data, bounds, breaks)
    lines = span_hashes(data, line_starts, line_ends, fold=False)
    out = np.zeros((len(bounds) - 1, len(STATISTICS)))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        n, size = b - a, int(bounds[i + 1] - bounds[i])
        row = [np.log1p(size), np.log1p(n)]
        counts = np.bincount(_CLASS[data[bounds[i] : bounds[i + 1]]], minlength=len(CLASSES) + 1)[1:] / max(1, size)
        if n:
            own = words[a:b]
            seen = np.unique(own, return_counts=True)[1]
            long = sizes[a:b]
            again = np.unique(windows[a : b - 2], return_counts=True)[1] if n > 2 else np.ones(1)
            said = lines[line_at[i] : line_at[i + 1]]
            row += [np.log(long.mean()), np.log1p(long.std()), *counts, len(seen) / n, seen.max() / n, float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0]
            row += [float(again[again > 1].sum() / again.sum()), 1 - len(np.unique(said)) / max(1, len(said)), float((long <= 2).mean()), float(firsts[a:b].mean())]
        else:
            row += [0.0, 0.0, *counts] + [0.0] * (len(STATISTICS) - 4 - len(counts))
        out[i] = row
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.5]), np.array([0.5])))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosines of the standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.turns + self.shifts) * np.sqrt(2 / len(self.shifts)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best rising fit of y over rising x: centres and means of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    whole = np.array(blocks)
    return whole[:, 0] / whole[:, 2], whole[:, 1] / whole[:, 2]


def _values(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(STATISTICS))


def with_statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the columns asked for, x (the statistics)."""
    rows = texts_of(docs, *more)
    names = [f.name for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                x = statistics(b.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], flat], [*names, "x"])

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "text")
    return mapped(rows, run, shape + "x array<double>")


def _summed(rows: DataFrame, parts, width: int) -> np.ndarray:
    """Sum over all rows of a vector of fixed width: per task, then in slices."""
    step = -(-width // SLICES)

    def partial(batches):
        whole = np.zeros(step * SLICES)
        for b in batches:
            if b.num_rows:
                whole[:width] += parts(b)
        cut = [whole[s * step : (s + 1) * step].tobytes() for s in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(cut)], ["slice", "sums"])

    def total(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"slice": table.column("slice")[:1], "sums": pa.array([whole.tobytes()])})

    shape = "slice int, sums binary"
    out = np.zeros(step * SLICES)
    for r in mapped(rows, partial, shape).groupBy("slice").applyInArrow(total, shape).collect():
        out[r.slice * step : (r.slice + 1) * step] = np.frombuffer(r.sums)
    return out[:width]


def fit(labelled: DataFrame, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = 17) -> Model:
    """From rows of x, label (0 or 1) and `calibrates` (true for rows of the calibration fold)."""
    d, rows = len(STATISTICS), labelled.select("x", F.col("label").cast("double").alias("label"), "calibrates")
    moments = _summed(rows, lambda b: np.concatenate([[b.num_rows], _values(b).sum(0), (_values(b) ** 2).sum(0)]), 1 + 2 * d)
    n = max(1.0, moments[0])
    mean = moments[1 : d + 1] / n
    spread = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0))
    r = np.random.Generator(np.random.PCG64(seed))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), r.normal(0, np.sqrt(2 * gamma), (d, features)), r.uniform(0, 2 * np.pi, features))
    if not moments[0]:
        return model
    size = features + 1

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_values(b)), b.column("label").to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows.where("not calibrates"), normal, size * size + size)
    if not sums[-size - 1]:  # no row but those of the calibration fold
        sums = _summed(rows, normal, size * size + size)
    penalty = np.eye(size) * ridge
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(sums[: size * size].reshape(size, size) + penalty, sums[size * size :])
    for part in (rows.where("calibrates"), rows):
        bins = _binned(part, model)
        if len(bins[0]):
            model.knots = pool_adjacent(*bins)
            break
    return model


def _binned(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of raw scores, in order, the share of label 1 in each, and the rows in each."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            raw = np.clip(sent.value.raw(_values(b)), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(raw * BINS).astype(np.int32)), b.column("label")], ["bin", "label"])

    found = mapped(rows, run, "bin int, label double").groupBy("bin").agg(F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    return tuple(np.array([f(r) for r in found], float) for f in (lambda r: (r.bin + 0.5) / BINS, lambda r: r["mean"], lambda r: r.n))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Adds score and predicted to rows with statistics."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(_values(b)))], [*b.schema.names, "score"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return mapped(rows, run, shape + ", score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fold_column() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def fit_on(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """From rows with doc_id, fold and x: folds 1 to 3 fit, fold 4 calibrates, fold 0 is never used."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    return fit(rows.where("fold <> 0").join(known, "doc_id").select("x", "label", (F.col("fold") == 4).alias("calibrates")))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = staged(with_statistics(docs, fold_column().alias("fold")), "statistics")
    return score(rows, fit_on(rows, labels)).select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", "predicted")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all columns; texts are scored by their fingerprint, once for equal texts."""
    rows = staged(with_statistics(docs, fold_column().alias("fold"), *text_key(F.coalesce(F.col("text"), F.lit("")))), "statistics")
    own = free_names(docs, 2)
    bad = score(rows, fit_on(rows, labels)).where("predicted = 0").select("_k1", "_k2").distinct().toDF(*own)
    keys = [k.alias(n) for n, k in zip(own, text_key(F.coalesce(F.col("text"), F.lit(""))), strict=True)]
    return docs.select("*", *keys).join(bad, own, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
