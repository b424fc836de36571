"""Language-model scores from a log-frequency Bloom filter.

Word and n-gram counts over all training texts are quantised on a logarithmic scale. The filter holds an n-gram
once for each level up to its own, so that probing level after level until one is missing reads the level back; a
false answer can only raise it. Probabilities are smoothed by orders:

    P1(w)         = (c(w) + 1) / (N + V + 1)
    Pn(w | v...)  = (c(v...w) + weight * Pn-1(w | ...)) / (c(v...) + weight)

A level stands for its smallest count above the line and for its largest below it, so that but for false answers the
probabilities of all words after v sum to one at most.

The filter holds every n-gram of the corpus, those seen once too. It is built in segments, one per range of hashes, by
the tasks that sum up the counts, and stored in the shared folder. A filter of `ROUND_BYTES` at most is sent to the workers
whole. A larger one stays where it is, and the questions go to it: texts are read once, the pairs of a stretch of texts
are dealt out by hash to places, each of which holds its range of the filter and gives back sums per row. A question
carries the level of its word: that of a frequent word is sent to the workers, a rare one asks the place of its word first.

Exact word counts, for the base score, stay in storage. The most frequent words, a million at most, are sent to the
workers; the others are looked up in a join, bucket by bucket, or at the place of the word.

Defined results: a null or empty text is its end token alone; rows with equal ids are separate rows; a null
doc_id counts as empty text in the choice of held-out rows; without training rows every count is 0; an
empty table gives an empty one; other columns are neither read nor returned."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.common import END, batch, buckets_for, joined_hashes, load, mapped, mix, slices, staged, texts_of, tidy, word_hashes

ROUND_BYTES = 16 << 20  # of the filters that are sent to workers at a time; a segment at least
PLACE_BYTES = 64 << 20  # of a filter that a task holds when questions go to it; a segment at least
ASK = 1 << 17  # keys that are looked up at once
SORTED_IN = 8  # parts, a power of two, in which the pairs of a chunk are sorted
OUT_BYTES = 2 << 20  # of records that a task gives out at once
READ_BYTES = 16 << 20  # of the filters that the driver reads at a time; a segment at least
BITS_PER_ENTRY = 10
PROBES = 6
GROWTH = 1.15
WEIGHT = 64.0
FREQUENT = 1_000_000  # words at most whose exact counts are sent to workers
FLUSH = 4 << 20
BEGIN = np.uint64(0x3C6EF372FE94F82B)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def thresholds(growth: float = GROWTH) -> np.ndarray:
    """Smallest count, in units, of level 1, 2, ...: whole numbers that grow by the factor in the long run."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


LEVELS = thresholds()


@dataclass
class Filter:
    """Segments of a Bloom filter by hash range: packed bits, and each segment's place and width."""

    bits: np.ndarray
    begins: np.ndarray
    widths: np.ndarray
    unit: int

    @staticmethod
    def spots(keys: np.ndarray, level: np.ndarray, width: np.ndarray | int):
        """Positions within a segment of each of the probes."""
        a = mix(keys ^ (level.astype(np.uint64) * _TURN))
        b = mix(a ^ _TURN)
        for _ in range(PROBES):
            yield ((a >> np.uint64(32)) * width) >> np.uint64(32)
            a = a + b

    @staticmethod
    def build(keys: np.ndarray, levels: np.ndarray) -> tuple[int, bytes]:
        """Width and bits of a segment that holds every key at levels 1 to its own."""
        width = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)
        marks = np.zeros(width, bool)
        live, level = np.flatnonzero(levels > 0), 1
        while len(live):
            for at in Filter.spots(keys[live], np.full(len(live), level), np.uint64(width)):
                marks[at.astype(np.int64)] = True
            level += 1
            live = live[levels[live] >= level]
        return width, np.packbits(marks, bitorder="little").tobytes()

    @classmethod
    def join(cls, segments: list[tuple[int, int, bytes]], buckets: int, unit: int) -> Filter:
        """From (bucket, width, bits) of the buckets that hold anything."""
        widths = np.zeros(buckets, np.uint64)
        begins = np.zeros(buckets, np.int64)
        parts, at = [], 0
        for bucket, width, bits in sorted(segments):
            widths[bucket], begins[bucket] = width, at
            parts.append(bits)
            at += width
        return cls(np.frombuffer(b"".join(parts), np.uint8), begins, widths, unit)

    @classmethod
    def empty(cls, sizes: dict[int, int], buckets: int) -> Filter:
        """Room for the segments of the given bytes by bucket."""
        widths, begins, at = np.zeros(buckets, np.uint64), np.zeros(buckets, np.int64), 0
        for bucket in sorted(sizes):
            widths[bucket], begins[bucket] = 8 * sizes[bucket], at
            at += 8 * sizes[bucket]
        return cls(np.zeros(at >> 3, np.uint8), begins, widths, 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, read by probing one level after another."""
        out = np.zeros(len(keys), np.int64)
        bucket = (keys >> np.uint64(64 - (len(self.widths).bit_length() - 1))).astype(np.int64)
        live = np.flatnonzero(self.widths[bucket] > 0)
        level = 1
        while len(live):
            own = bucket[live]
            hit = np.ones(len(live), bool)
            for at in Filter.spots(keys[live], np.full(len(live), level), self.widths[own]):
                spot = self.begins[own] + at.astype(np.int64)
                hit &= (self.bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = level
            level += 1
        return out

    def least(self, levels: np.ndarray) -> np.ndarray:
        return np.where(levels > 0, LEVELS[np.maximum(levels, 1) - 1] * self.unit, 0)

    def most(self, levels: np.ndarray) -> np.ndarray:
        return LEVELS[levels] * self.unit - 1


def level_of(counts: np.ndarray, unit: int) -> np.ndarray:
    return np.searchsorted(LEVELS, counts // unit, "right")


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and the n+1 offsets of the texts."""
    words, at = word_hashes(column)
    bounds = at + np.arange(len(at))
    out = np.full(bounds[-1], END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = words
    return out, bounds


def grams_of(tokens: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Per token the hash of the n-gram that ends there; n-1 begin marks stand before each text."""
    if n == 1:
        return tokens
    texts = len(bounds) - 1
    at = np.arange(len(tokens)) + np.repeat(np.arange(1, texts + 1), np.diff(bounds)) * (n - 1)
    padded = np.full(len(tokens) + texts * (n - 1), BEGIN, np.uint64)
    padded[at] = tokens
    return joined_hashes(padded, n)[at - (n - 1)]


def planes(numbers: np.ndarray) -> bytes:
    """First bytes of all numbers, then their second bytes, ...: high bytes, which hardly change, compress to nothing."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _cuts(keys: np.ndarray, places: int) -> np.ndarray:
    """Where the keys of each place begin among sorted ones, and the end."""
    lows = np.arange(places, dtype=np.uint64) << np.uint64(64 - (places.bit_length() - 1)) if places > 1 else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, lows), len(keys))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by the columns, differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _lengths(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(starts, size))


_COUNTED = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])


def _summed(parts: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of the keys, which are taken out of the list; a batch holds some of the buckets."""
    found = np.concatenate(parts)
    parts.clear()
    found.sort()
    first = np.flatnonzero(_starts(found))
    keys, counts = found[first], _lengths(first, len(found))
    del found, first
    edges = _cuts(keys, buckets)
    for low in range(0, buckets, 32):
        rows = []
        for n in range(low, min(low + 32, buckets)):
            k, c = (x[edges[n] : edges[n + 1]] for x in (keys, counts))
            if len(k):
                rows.append((n, planes(k[c == 1]), planes(k[c > 1]), planes(c[c > 1].astype("<i8"))))
        if rows:
            yield batch(_COUNTED, bucket=[r[0] for r in rows], once=[r[1] for r in rows], more=[r[2] for r in rows], counts=[r[3] for r in rows])


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket, in order, with their counts."""
    once, more, counts = (np.concatenate([from_planes(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("once", "<u8"), ("more", "<u8"), ("counts", "<i8")))
    keys, at = np.unique(np.concatenate([once, more]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([np.ones(len(once)), counts]), len(keys)).astype(np.int64)


def gram_counts(rows: DataFrame, n: int, buckets: int):
    """n-grams of all rows, counted within each task and dealt out by hash range."""

    def run(batches):
        kept, size = [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                kept.append(grams_of(*tokens_of(b.column("text")), n))
                size += len(kept[-1])
                if size >= FLUSH:
                    yield from _summed(kept, buckets)
                    size = 0
        if size:
            yield from _summed(kept, buckets)

    return mapped(rows, run, "bucket int, once binary, more binary, counts binary").groupBy("bucket")


@dataclass
class Part:
    """What a worker needs in a round: filters by order that hold the given ranges of buckets, and the totals."""

    filters: list[Filter]
    ranges: list[tuple[int, int]]
    n: int
    v: int
    texts: int
    weight: float

    def owned(self, keys: np.ndarray, order: int) -> np.ndarray:
        bucket = (keys >> np.uint64(64 - (len(self.filters[order - 1].widths).bit_length() - 1))).astype(np.int64)
        low, high = self.ranges[order - 1]
        return (bucket >= low) & (bucket < high)

    @staticmethod
    def looked_up(held: Filter, keys: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(keys, return_inverse=True)
        return held.levels(distinct)[at]

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        return self.looked_up(self.filters[order - 1], keys)

    def token_scores(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """This part's share of the log10 probability of each token. A token's count belongs to the part that has its grams
        of every order, the count of its context to the part that has the context and the first range of pairs."""
        out = np.zeros(len(tokens))
        words = self.owned(tokens, 1)
        if not words.any() and self.ranges[0][0] > 0:
            return out
        held = self.filters[0]
        levels = np.zeros(len(tokens), np.int64)
        levels[words] = self.levels(tokens[words], 1)
        p = (held.least(levels) + 1.0) / (self.n + self.v + 1.0)
        if len(self.filters) == 1:
            out[words] = np.log10(p[words])
            return out
        pairs = grams_of(tokens, bounds, 2)
        own = np.flatnonzero(words & self.owned(pairs, 2))
        out[own] = np.log10(self.filters[1].least(self.levels(pairs[own], 2)) + self.weight * p[own])
        if self.ranges[1][0] == 0:
            first = np.zeros(len(tokens), bool)
            first[bounds[:-1]] = True
            known = np.flatnonzero(words[:-1] & ~first[1:])
            out[known + 1] -= np.log10(held.most(levels[known]) + self.weight)
            if self.ranges[0][0] == 0:
                out[first] -= np.log10(self.texts + self.weight)
        return out


@dataclass
class Model:
    """The stored segments by order, their ranges by round, the totals, and exact counts and filter levels of frequent words."""

    segments: list[DataFrame]
    ranges: list[list[tuple[int, int]]]
    buckets: int
    n: int
    v: int
    texts: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    frequent_levels: np.ndarray
    weight: float = WEIGHT

    def parts(self) -> Iterator[Part]:
        """One part a round; only its segments are read. Nothing of a part is kept here once it is given out."""
        for ranges in itertools.product(*self.ranges):
            yield Part([self._filter(stored, *r) for stored, r in zip(self.segments, ranges, strict=True)], list(ranges), self.n, self.v, self.texts, self.weight)

    def _filter(self, stored: DataFrame, low: int, high: int) -> Filter:
        """The segments of a range of buckets, read some at a time into one array, so that the driver holds them once."""
        sizes = {r.bucket: r.width // 8 for r in stored.where(F.col("bucket").between(low, high - 1)).select("bucket", "width").collect()}
        whole = Filter.empty(sizes, self.buckets)
        for a, b in ranges_of(sizes, self.buckets, READ_BYTES):
            if not any(a <= k < b for k in sizes):
                continue
            found = stored.where(F.col("bucket").between(max(a, low), min(b, high) - 1)).select("bucket", "bits").collect()
            for bucket, bits in found:
                begin = int(whole.begins[bucket]) >> 3
                whole.bits[begin : begin + len(bits)] = np.frombuffer(bits, np.uint8)
            del found
        return whole

    def rounds(self) -> int:
        return math.prod(len(r) for r in self.ranges)

    def token_scores(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        return sum(part.token_scores(tokens, bounds) for part in self.parts())


def ranges_of(sizes: dict[int, int], buckets: int, most: int) -> list[tuple[int, int]]:
    """Ranges of buckets that cover all, of `most` bytes each or of a single bucket."""
    out, low, size = [], 0, 0
    for b in range(buckets):
        if b > low and size + sizes.get(b, 0) > most:
            out.append((low, b))
            low, size = b, 0
        size += sizes.get(b, 0)
    return [*out, (low, buckets)]


def freed(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished step once the driver's JVM finds its tables unused, which it doesn't by itself
    while it has memory."""
    spark.sparkContext._jvm.System.gc()


def fit(docs: DataFrame, order: int = 2, weight: float = WEIGHT) -> tuple[Model, DataFrame]:
    """The model of all given rows, and the stored exact word counts (bucket, keys, counts) in hash order."""
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    spark = docs.sparkSession
    rows, buckets = texts_of(docs), buckets_for(spark)

    def segment(keys, counts, bucket):
        width, bits = Filter.build(keys, level_of(counts, 1))
        return {"bucket": pa.array([bucket], pa.int32()), "width": pa.array([width], pa.int64()), "bits": pa.array([bits], pa.binary())}

    def store(table: pa.Table) -> pa.Table:
        keys, counts = _totals(table)
        held = {"keys": pa.array([keys.tobytes()]), "counts": pa.array([counts.tobytes()]), "n": pa.array([int(counts.sum())]), "v": pa.array([len(keys)]), "ends": pa.array([int(counts[keys == END].sum())]), "sizes": pa.array([np.bincount(level_of(counts, 1), minlength=len(LEVELS) + 1)])}
        return pa.table(segment(keys, counts, table.column("bucket")[0].as_py()) | held)

    words = staged(gram_counts(rows, 1, buckets).applyInArrow(store, "bucket int, width long, bits binary, keys binary, counts binary, n long, v long, ends long, sizes array<long>"), "word-counts")
    total = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("ends").alias("ends")).first()
    n, v, texts = (total[k] or 0 for k in ("n", "v", "ends"))

    segments = [words.select("bucket", "width", "bits")]
    if order > 1:

        def pair_segments(table: pa.Table) -> pa.Table:
            keys, counts = _totals(table)
            return pa.table(segment(keys, counts, table.column("bucket")[0].as_py()))

        segments.append(staged(gram_counts(rows, 2, buckets).applyInArrow(pair_segments, "bucket int, width long, bits binary"), "pair-segments"))
    ranges, room = [], ROUND_BYTES
    for left, stored in zip(range(order, 0, -1), segments, strict=True):
        sizes = {r.bucket: r.width // 8 for r in stored.select("bucket", "width").collect()}
        ranges.append(ranges_of(sizes, buckets, room // left))
        room -= max(sum(sizes.get(b, 0) for b in range(*r)) for r in ranges[-1])

    above = np.cumsum(sum((np.array(r.sizes) for r in words.select("sizes").collect()), np.zeros(len(LEVELS) + 1, np.int64))[::-1])[::-1]
    least = LEVELS[max(1, int(np.argmax(above <= FREQUENT))) - 1]

    def frequent(batches):
        for b in batches:
            for bucket, width, bits, keys, counts in zip(*(b.column(c).to_pylist() for c in ("bucket", "width", "bits", "keys", "counts")), strict=True):
                k, c = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8")
                often = c >= least
                levels = Filter.join([(bucket, width, bits)], buckets, 1).levels(k[often])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (k[often], c[often], levels.astype("<u2"))], ["keys", "counts", "levels"])

    common = mapped(words.select("bucket", "width", "bits", "keys", "counts"), frequent, "keys binary, counts binary, levels binary").collect()
    keys, counts, levels = (np.frombuffer(b"".join(r[c] for r in common), t) for c, t in (("keys", "<u8"), ("counts", "<i8"), ("levels", "<u2")))
    ranked = np.argsort(keys)
    freed(spark)
    model = Model(segments, ranges, buckets, n, v, texts, keys[ranked], counts[ranked], levels[ranked], weight)
    return model, words


def score(docs: DataFrame, model: Model, words: DataFrame, *more: Column) -> DataFrame:
    """Per row of docs: doc_id, the columns asked for, n_tokens, n_known, train_tokens, base_score, score."""
    if model.rounds() > 1:
        return dealt(docs, model, words, *more)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(next(model.parts()))
    tidy()
    common = spark.sparkContext.broadcast((model.frequent, model.frequent_counts))
    rows = texts_of(docs, *more)
    extra = [f for f in rows.schema.fields if f.name not in ("doc_id", "text")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)

    def run(batches):
        part, (frequent, frequent_counts) = sent.value, common.value
        for whole in batches:
            for b in slices(whole, "text"):
                tokens, bounds = tokens_of(b.column("text"))
                texts = len(bounds) - 1
                keys, at = np.unique(tokens, return_inverse=True)
                place = np.minimum(np.searchsorted(frequent, keys), max(0, len(frequent) - 1))
                often = frequent[place] == keys if len(frequent) else np.zeros(len(keys), bool)
                logs = np.where(often, np.log10(1.0 + (frequent_counts[place] if len(frequent) else 0)), 0.0)
                owner = np.repeat(np.arange(texts), np.diff(bounds))
                total = lambda x: np.bincount(owner, x, texts)  # noqa: B023, E731
                scores = total(part.token_scores(tokens, bounds))
                rare = ~often[at]
                pairs, counts = _pairs(owner[rare], at[rare], len(keys))
                cuts = np.searchsorted(pairs[0], np.arange(texts + 1))
                hashes = keys[pairs[1]]
                lists = [[x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for x in (hashes, counts.astype("<i4"))]
                made = [pa.array(x) for x in (np.diff(bounds), total(often[at].astype(float)).astype(np.int64), total(logs[at]), scores)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *[b.column(f.name) for f in extra], *made, pa.array(lists[0], pa.binary()), pa.array(lists[1], pa.binary())],
                    ["doc_id", *[f.name for f in extra], "n_tokens", "known", "logs", "score", "rare", "times"],
                )

    schema = "doc_id long" + f", {shape}" * bool(extra) + ", n_tokens long, known long, logs double, score double, rare binary, times binary"
    # the row number is stored with the rows, so it names a row for good
    scored = staged(mapped(rows, run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    sent.destroy()
    found = _looked_up(scored, words).groupBy("row").agg(F.sum("known").alias("rare_known"), F.sum("logs").alias("rare_logs"))
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1)))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id",
        *[f.name for f in extra],
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


#: Kinds of records: parts of a filter, questions, what is known of the rows of a chunk, sums from places, sums of the second round.
HELD, ASKED, INFO, SUMS, LATE = range(5)
_BYTES = ["keys", "counts", "levels", "rows", "times", "pairs", "known", "logs", "sums", "info"]
_RECORD = pa.schema([("place", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in _BYTES]])
_KNOWN = ["_n_tokens", "_known", "_logs", "_score"]
_RECORD_SQL = "place int, kind int, chunk long, " + ", ".join(f"{c} binary" for c in _BYTES)


def _records(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in found], f.type) for f in _RECORD], schema=_RECORD)


def _given_out(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Records in batches of `OUT_BYTES`, or of one record."""
    kept, size = [], 0
    for r in found:
        kept.append(r)
        size += sum(len(x) for x in r.values() if isinstance(x, bytes))
        if size >= OUT_BYTES:
            yield _records(kept)
            kept, size = [], 0
    if kept:
        yield _records(kept)


def places_for(sizes: dict[int, int], buckets: int, least: int) -> int:
    """Power of two of equal ranges of buckets, `least` if there are so many, that hold `PLACE_BYTES` each at most, unless a single
    bucket holds more. Few, as every place gives back a sum for most rows."""
    n = min(buckets, least)
    while n < buckets and max(sum(sizes.get(b, 0) for b in range(x, x + buckets // n)) for x in range(0, buckets, buckets // n)) > PLACE_BYTES:
        n *= 2
    return n


def pair_questions(keys: np.ndarray, rows: np.ndarray, levels: np.ndarray, times: np.ndarray | None, places: int, chunk: int) -> Iterator[dict]:
    """Questions of a chunk by place: distinct pairs, the levels of their words, and the rows of each with their times."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")  # rows come in order, so those of a pair stay in order
    k, r = keys[order], rows[order]
    new = _starts(k)
    first = np.flatnonzero(new | _starts(r))
    times = _lengths(first, len(k)) if times is None else np.add.reduceat(times[order], first)
    heads = np.flatnonzero(new[first])
    counts, entries = _lengths(heads, len(first)), np.append(heads, len(first))
    k, r, levels = k[first[heads]], r[first], levels[order[first[heads]]]
    cuts = _cuts(k, places)
    for place, (x, y) in enumerate(itertools.pairwise(cuts.tolist())):
        if y > x:
            i, j = entries[x], entries[y]
            yield {"place": place, "kind": ASKED, "chunk": chunk, "keys": planes(k[x:y]), "levels": planes(levels[x:y].astype("<u2")), "counts": planes(counts[x:y].astype("<u4")), "rows": planes(r[i:j].astype("<u4")), "times": planes(times[i:j].astype("<u4"))}


def word_questions(words: np.ndarray, rows: np.ndarray, pairs: np.ndarray, pair_places: int, places: int, chunk: int) -> Iterator[dict]:
    """Questions of a chunk by place: distinct rare words, and the pairs and rows of each with their times."""
    if not len(words):
        return
    order = np.lexsort((rows, pairs, words))
    w, p, r = words[order], pairs[order], rows[order]
    new = _starts(w)
    first = np.flatnonzero(new | _starts(p, r))
    times, heads = _lengths(first, len(w)), np.flatnonzero(new[first])
    counts, entries = _lengths(heads, len(first)), np.append(heads, len(first))
    w, p, r = w[first[heads]], p[first], r[first]
    for place, (x, y) in enumerate(itertools.pairwise(_cuts(w, places).tolist())):
        if y > x:
            i, j = entries[x], entries[y]
            yield {"place": pair_places + place, "kind": ASKED, "chunk": chunk, "keys": planes(w[x:y]), "counts": planes(counts[x:y].astype("<u4")), "rows": planes(r[i:j].astype("<u4")), "times": planes(times[i:j].astype("<u4")), "pairs": planes(p[i:j])}


@dataclass
class Scale:
    """The totals of a model, and how many places share its filters."""

    n: int
    v: int
    texts: int
    weight: float
    order: int
    buckets: int
    pair_places: int
    word_places: int

    def share(self, held: Filter, levels: np.ndarray) -> np.ndarray:
        return (held.least(levels) + 1.0) / (self.n + self.v + 1.0)

    def word_sums(self, held: Filter, words: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """What each occurrence of a word adds to the score by itself: as the context of the next token, or alone where there are no pairs."""
        if self.order == 1:
            return np.log10(self.share(held, levels))
        return np.where(words == END, 0.0, -np.log10(held.most(levels) + self.weight))


class Place:
    """A range of the filter, and for words the exact counts, in a task that is sent questions about it. What it is asked is kept
    until there is enough to look up at once; the questions of a chunk stay together, so equal texts have equal sums."""

    def __init__(self, number: int, scale: Scale, late: bool):
        self.number, self.scale, self.late = number, scale, late
        self.segments, self.exact, self.filter = [], [], None
        self.waiting, self.size = [], 0

    def hold(self, get) -> None:
        self.segments.append((get("bucket").as_py(), get("width").as_py(), get("bits").as_py()))
        if self.number >= self.scale.pair_places:
            self.exact.append((self.segments[-1][0], get("keys").as_py(), get("counts").as_py()))

    def ask(self, chunk: int, get) -> Iterator[dict]:
        if self.filter is None:
            self.filter = Filter.join(self.segments, self.scale.buckets, 1)
            self.exact.sort()
            self.keys, self.counts = (np.frombuffer(b"".join(x[i] for x in self.exact), t) for i, t in ((1, "<u8"), (2, "<i8")))
            self.segments, self.exact = [], []
        if self.size >= ASK and self.waiting[-1][0] != chunk:
            yield from self.answer()
        kinds = {"keys": "<u8", "counts": "<u4", "levels": "<u2", "rows": "<u4", "times": "<u4", "pairs": "<u8"}
        found = {c: from_planes(x.as_buffer(), t) for c, t in kinds.items() if (x := get(c)).is_valid}
        self.waiting.append((chunk, found))
        self.size += len(found["keys"])

    def answer(self) -> Iterator[dict]:
        if not self.waiting:
            return
        chunks = np.array([c for c, _ in self.waiting])
        whole = {c: np.concatenate([x[c] for _, x in self.waiting]) for c in self.waiting[0][1]}
        owner = np.repeat(np.arange(len(chunks)), [len(x["rows"]) for _, x in self.waiting])
        self.waiting, self.size = [], 0
        if self.number >= self.scale.pair_places:
            yield from self._words(chunks, owner, **whole)
        else:
            yield from self._pairs(chunks, owner, **whole)

    def _pairs(self, chunks, owner, keys, counts, levels, rows, times) -> Iterator[dict]:
        seen = self.filter.least(Part.looked_up(self.filter, keys))
        sums = np.repeat(np.log10(seen + self.scale.weight * self.scale.share(self.filter, levels)), counts) * times
        yield from self._sums(chunks, owner, rows, np.repeat(keys, counts), {"sums": sums})

    def _words(self, chunks, owner, keys, counts, rows, times, pairs) -> Iterator[dict]:
        c = np.zeros(len(keys), np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            c = np.where(self.keys[place] == keys, self.counts[place], 0)
        levels = Part.looked_up(self.filter, keys)
        sums = self.scale.word_sums(self.filter, keys, levels)
        each = lambda x: np.repeat(x, counts) * times
        yield from self._sums(chunks, owner, rows, np.repeat(keys, counts), {"sums": each(sums), "logs": each(np.log10(c + 1.0)), "known": each(c > 0).astype("<i8")})
        if self.scale.order > 1:
            levels = np.repeat(levels, counts)
            for n, chunk in enumerate(chunks.tolist()):
                own = slice(*np.searchsorted(owner, [n, n + 1]))
                yield from pair_questions(pairs[own], rows[own], levels[own], times[own], self.scale.pair_places, chunk)

    def _sums(self, chunks, owner, rows, keys, values: dict[str, np.ndarray]) -> Iterator[dict]:
        """Sums per chunk and row, added up in the order of keys."""
        known, of = np.unique(chunks, return_inverse=True)
        if len(chunks) == 1:  # in order of keys as it comes
            held, at = np.unique(rows, return_inverse=True)
            ends = [0, len(held)]
        else:
            of = of[owner]
            order = np.lexsort((keys, rows, of))
            new = _starts(of[order], rows[order])
            at, held = np.cumsum(new) - 1, rows[order][new]
            values = {c: x[order] for c, x in values.items()}
            ends = np.searchsorted(of[order][new], np.arange(len(known) + 1))
        sums = {c: np.bincount(at, x, len(held)).astype(x.dtype) for c, x in values.items()}
        for chunk, (i, j) in zip(known.tolist(), itertools.pairwise(ends), strict=True):
            yield {"place": self.number, "kind": LATE if self.late else SUMS, "chunk": chunk, "rows": planes(held[i:j])} | {c: planes(x[i:j]) for c, x in sums.items()}


def _answers(scale: Scale, late: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records in order of place, kind and chunk: questions are answered, what is known of rows goes through."""

    def run(batches):
        place = Place(-1, scale, late)
        for b in batches:
            numbers, kinds, chunks = (b.column(c).to_pylist() for c in ("place", "kind", "chunk"))
            for i, (number, kind, chunk) in enumerate(zip(numbers, kinds, chunks, strict=True)):
                get = lambda c: b.column(c)[i]  # noqa: B023, E731
                if number != place.number:
                    yield from place.answer()
                    place = Place(number, scale, late)
                if kind == HELD:
                    place.hold(get)
                elif kind == ASKED:
                    yield from place.ask(chunk, get)
                else:
                    yield {"place": number, "kind": kind, "chunk": chunk, "info": get("info").as_py()}
        yield from place.answer()

    return lambda batches: _given_out(run(batches))


def dealt(docs: DataFrame, model: Model, words: DataFrame, *more: Column) -> DataFrame:
    """Scores with a filter that is not sent to workers: texts are read once, questions are dealt out to the places of the filter."""
    spark = docs.sparkSession
    sizes = [{r.bucket: r.size for r in stored.select("bucket", size.alias("size")).collect()} for stored, size in ((model.segments[-1], F.col("width") / 8), (words, F.col("width") / 8 + 16 * F.col("v")))]
    pair_places, word_places = (places_for(s, model.buckets, n) for s, n in zip(sizes, (32, 16), strict=True))
    scale = Scale(model.n, model.v, model.texts, model.weight, len(model.segments), model.buckets, pair_places if len(model.segments) > 1 else 0, word_places)
    common = spark.sparkContext.broadcast((model.frequent, model.frequent_counts, model.frequent_levels))
    rows = texts_of(docs, *more)
    extra = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name not in ("doc_id", "text")}

    def seen(b: pa.RecordBatch, row: int):
        """What is known of the rows, and the tokens of frequent and of rare words: pairs and rows, then levels or words."""
        frequent, frequent_counts, frequent_levels = common.value
        tokens, bounds = tokens_of(b.column("text"))
        texts = len(bounds) - 1
        owner = np.repeat(np.arange(texts, dtype=np.uint32), np.diff(bounds))
        keys, at = np.unique(tokens, return_inverse=True)
        place = np.minimum(np.searchsorted(frequent, keys), max(0, len(frequent) - 1))
        often = frequent[place] == keys if len(frequent) else np.zeros(len(keys), bool)
        levels, counts = (np.where(often, x[place] if len(frequent) else 0, 0) for x in (frequent_levels, frequent_counts))
        total = lambda x: np.bincount(owner, np.where(often, x, 0)[at], texts)
        begin = np.log10(scale.texts + scale.weight) if scale.order > 1 else 0.0
        made = [np.diff(bounds), total(1).astype(np.int64), total(np.log10(1.0 + counts)), total(scale.word_sums(Filter.empty({}, 1), keys, levels)) - begin]
        info = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *extra)), *(pa.array(x) for x in made)], ["doc_id", *extra, *_KNOWN])
        pairs = grams_of(tokens, bounds, 2) if scale.order > 1 else np.zeros(len(tokens), np.uint64)
        owner += np.uint32(row)
        mine = often[at]
        return info, (pairs[mine], owner[mine], levels.astype(np.uint16)[at[mine]]), (pairs[~mine], owner[~mine], tokens[~mine])

    def questions(parts: list, chunk: int) -> Iterator[dict]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0][0].schema) as out:
            for info, _, _ in parts:
                out.write_batch(info)
        yield {"place": chunk % (scale.pair_places + scale.word_places), "kind": INFO, "chunk": chunk, "info": sink.getvalue().to_pybytes()}
        pairs, rows, tokens = (np.concatenate([x[2][i] for x in parts]) for i in range(3))
        yield from word_questions(tokens, rows, pairs, scale.pair_places, scale.word_places, chunk)
        del pairs, rows, tokens
        if scale.order > 1:
            for part in range(SORTED_IN):
                own = [x[1][0] >> np.uint64(65 - SORTED_IN.bit_length()) == part for x in parts]
                pairs, rows, levels = (np.concatenate([x[1][i][o] for x, o in zip(parts, own, strict=True)]) for i in range(3))
                yield from pair_questions(pairs, rows, levels, None, scale.pair_places, chunk)

    def ask(batches):
        def found():
            chunk = TaskContext.get().partitionId() << 33
            parts, size, row = [], 0, 0
            for whole in batches:
                for b in slices(whole, "text"):
                    parts.append(seen(b, row))
                    row += b.num_rows
                    size += sum(len(x[0]) for x in parts[-1][1:])
                    if size >= FLUSH // 2:
                        yield from questions(parts, chunk)
                        parts, size, row, chunk = [], 0, 0, chunk + 1
            if size:
                yield from questions(parts, chunk)

        return _given_out(found())

    def place_of(places: int, first: int) -> Column:
        return (F.expr(f"shiftright(bucket, {(model.buckets // places).bit_length() - 1})") + first).cast("int").alias("place")

    def answered(asked: DataFrame, *held: DataFrame, late: bool = False) -> DataFrame:
        for part in held:
            asked = asked.unionByName(part.withColumn("kind", F.lit(HELD)), allowMissingColumns=True)
        dealt_out = asked.repartitionById(scale.pair_places + scale.word_places, "place")
        return mapped(dealt_out.sortWithinPartitions("place", "kind", "chunk"), _answers(scale, late), _RECORD_SQL)

    pair_parts = [stored.select(place_of(pair_places, 0), "bucket", "width", "bits") for stored in model.segments[1:]]
    word_parts = words.select(place_of(word_places, scale.pair_places), "bucket", "width", "bits", "keys", "counts")
    first = staged(answered(mapped(rows, ask, _RECORD_SQL), *pair_parts, word_parts), "answered")
    common.destroy()
    freed(spark)
    found = first.where(F.col("kind") >= INFO)
    if pair_parts:
        found = found.unionByName(answered(first.where(F.col("kind") == ASKED), *pair_parts, late=True))
    log_all = float(np.log10(model.n + model.v + 1))

    def summed(table: pa.Table) -> pa.Table:
        """The rows of a chunk; sums are added in the order of places."""
        order = sorted(range(table.num_rows), key=lambda i: (table.column("kind")[i].as_py(), table.column("place")[i].as_py()))
        info = pa.ipc.open_stream(table.column("info")[order[0]].as_buffer()).read_all()
        known, logs, score = (info.column(c).to_numpy().copy() for c in _KNOWN[1:])
        for i in order[1:]:
            at = from_planes(table.column("rows")[i].as_buffer(), "<u4")
            for into, c in ((known, "known"), (logs, "logs"), (score, "sums")):
                if (x := table.column(c)[i]).is_valid:
                    into[at] += from_planes(x.as_buffer(), into.dtype)
        n_tokens = info.column("_n_tokens")
        made = {"n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(len(known), scale.n, np.int64), "base_score": logs - n_tokens.to_numpy() * log_all, "score": score}
        out = info.select(["doc_id", *extra])
        for name, x in made.items():
            out = out.append_column(name, x if isinstance(x, pa.ChunkedArray) else pa.array(x))
        return out

    shape = "".join(f"`{name}` {kind}, " for name, kind in extra.items())
    return found.select("chunk", "kind", "place", "rows", "known", "logs", "sums", "info").groupBy("chunk").applyInArrow(summed, f"doc_id long, {shape}n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _pairs(owner: np.ndarray, key: np.ndarray, keys: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (owner, key) in order, and how often each occurs."""
    both, counts = np.unique(owner * max(1, keys) + key, return_counts=True)
    return (both // max(1, keys), both % max(1, keys)), counts


def _looked_up(scored: DataFrame, words: DataFrame) -> DataFrame:
    """Per row and bucket of rare words: how many tokens are known, and the sum of their log10(count + 1)."""
    spark = scored.sparkSession
    buckets = buckets_for(spark)

    def ask(batches):
        for b in batches:
            rare = np.frombuffer(b"".join(b.column("rare").to_pylist()), "<u8")
            times = np.frombuffer(b"".join(b.column("times").to_pylist()), "<i4")
            sizes = [len(x) // 8 for x in b.column("rare").to_pylist()]
            rows = np.repeat(b.column("row").to_numpy(), sizes)
            bucket = rare >> np.uint64(64 - (buckets.bit_length() - 1))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            out = [(n, *(x[order[i:j]].tobytes() for x in (rare, times, rows))) for n, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
            kinds = {"bucket": pa.int32(), "rare": pa.binary(), "times": pa.binary(), "rows": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds.values())], list(kinds))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        # a side without the bucket comes as a table without columns
        whole = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()) if t.num_rows else b"", kind)
        rare, times, rows = (whole(asked, c, k) for c, k in (("rare", "<u8"), ("times", "<i4"), ("rows", "<i8")))
        keys, counts = whole(known, "keys", "<u8"), whole(known, "counts", "<i8")
        c = np.zeros(len(rare))
        if len(keys):
            place = np.minimum(np.searchsorted(keys, rare), len(keys) - 1)
            c = np.where(keys[place] == rare, counts[place], 0)
        own, at = np.unique(rows, return_inverse=True)
        return pa.table({"row": pa.array(own, pa.int64()), "known": pa.array(np.bincount(at, times * (c > 0), len(own)).astype(np.int64)), "logs": pa.array(np.bincount(at, times * np.log10(c + 1.0), len(own)), pa.float64())})

    asked = mapped(scored.select("row", "rare", "times").where(F.length("rare") > 0), ask, "bucket int, rare binary, times binary, rows binary")
    return asked.groupBy("bucket").cogroup(words.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(answer, "row long, known long, logs double")


def held_out_column() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def op1(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all rows under the model of the rows that are not held out."""
    model, words = fit(docs.where(~held_out_column()), order)
    return score(docs, model, words, held_out_column().alias("held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # records are large, and an executor holds several batches outside its heap
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    return op1(load(spark, sf_dir, "documents"))
