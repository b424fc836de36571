"""Importance resampling towards a target distribution of hashed n-grams.

Features are the runs of one to three consecutive words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo the number
of buckets. Totals per bucket over the documents and over the target texts give each bucket's gain, a document's weight is the
sum of its features' gains, and Gumbel noise from a hash of its id turns weights into a draw without replacement.

A head-tail vocabulary keeps the hashing cheap without changing a result. The head is sent to all workers: for frequent words
the CRC states (alone and after a space) and the length, for frequent pairs the state and the bucket. It sits in tables of
fixed size, addressed by the word's or pair's 64-bit hash, so its size never depends on the data. What the tables lack, the
tail, takes its CRC directly from the bytes. States of neighbours are joined by CRC-32's linearity: the state of a run followed
by n more bytes is the run's state moved on by n zero bytes, xor the state of those bytes. Whether a feature is in the head or
not, its bucket is the same; totals are exact.

Text is read three times (head, totals, weights); no feature leaves a task. Shuffled are at most `HEAD_SHARE` words and pairs
of some MB of text, one count per bucket and task, and one slim row per document for the ranks.

Defined results: a null or empty text, or one without words, has no features and weight 0; a null doc_id draws its noise from
`<seed>:`; rows with equal ids draw the same noise and are ranked one after the other, ties by (doc_id, n_features, weight); an
empty table gives an empty one; no target text gives the gains of t = T = 0; other columns are neither read nor returned."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.functions.ordered import with_row_number
from hazardloom.llm.common import _FOLD, batch, joined_hashes, load, mapped, slices, span_hashes, staged, text_bytes, texts_of, word_spans

BUCKETS = 10_000
ORDER = 3  # longest run of words
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
SLOT_BITS = 16  # of the tables of frequent words and pairs
HEAD_SHARE = 1 << 14  # a word or pair is frequent if it is one of so many at least
LONG_WORD = 64  # bytes from which a word takes its CRC from zlib alone

NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_SHARED: dict[str, np.ndarray] = {}


def byte_table() -> np.ndarray:
    """The CRC-32 step of every byte."""
    if "step" not in _SHARED:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
        _SHARED["step"] = table
    return _SHARED["step"]


def zero_tables() -> np.ndarray:
    """[n, k, byte]: what byte k of a state becomes after n zero bytes, for n up to LONG_WORD."""
    if "zeros" not in _SHARED:
        step, out = byte_table(), np.empty((LONG_WORD + 1, 4, 256), np.uint32)
        out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(1, LONG_WORD + 1):
            out[n] = step[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
        _SHARED["zeros"] = out
    return _SHARED["zeros"]


def moved_on(states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each state after as many zero bytes; sizes are at most LONG_WORD."""
    flat = zero_tables().reshape(-1)
    at = sizes * 1024
    out = flat[at + (states & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= flat[at + (256 * k) + ((states >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def direct_states(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span, a byte of all spans at a time; long spans one by one."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    short = np.flatnonzero(sizes <= LONG_WORD)
    order = short[np.argsort(-sizes[short], kind="stable")]
    longer = np.searchsorted(-sizes[order], -np.arange(LONG_WORD), "left")  # spans longer than j come first
    at, step = starts[order], byte_table()
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(LONG_WORD):
        n = int(longer[j])
        if not n:
            break
        state[:n] = step[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


class Head:
    """Tables of frequent words and pairs, addressed by the top bits of their hashes; one entry a slot."""

    def __init__(self, words: dict | None = None, pairs: dict | None = None):
        empty = {"hash": np.zeros(0, np.uint64), "crc": np.zeros(0, np.uint32), "size": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
        self.tables = []
        for rows in (words or empty, pairs or empty):
            order = np.argsort(rows["n"], kind="stable")  # of two in a slot the more frequent is written last
            slot = (rows["hash"][order] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            keys = np.zeros(1 << SLOT_BITS, np.uint64)
            crc, size = np.zeros(1 << SLOT_BITS, np.uint32), np.full(1 << SLOT_BITS, -1, np.int32)
            keys[slot], crc[slot], size[slot] = rows["hash"][order], rows["crc"][order], rows["size"][order]
            self.tables.append((keys, crc, size))
        keys, crc, size = self.tables[0]
        short = np.clip(size, 0, LONG_WORD).astype(np.int64)
        self.spaced = moved_on(np.full(len(crc), zlib.crc32(b" "), np.uint32), short) ^ crc
        self.pair_buckets = (self.tables[1][1] % np.uint32(BUCKETS)).astype(np.int64)

    def find(self, kind: int, hashes: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the hashes, and whether each is held."""
        keys, _, size = self.tables[kind]
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = (keys[slot] == hashes) & (size[slot] >= 0)
        return slot, held if sizes is None else held & (size[slot] == sizes)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and sizes of the words, and the n+1 offsets of the texts into the words."""
    data, bounds = text_bytes(column)
    starts, ends, at = word_spans(data, bounds, NOT_WORD)
    return _FOLD[data], starts, ends - starts, at


def after(states: np.ndarray, crcs: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """States of runs followed by a space and a further word, given the word's state after a space."""
    out = moved_on(states, np.minimum(sizes + 1, LONG_WORD)) ^ crcs
    for i in np.flatnonzero(sizes + 1 > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], zlib.crc32(b" ", int(states[i])))
    return out


def feature_buckets(column: pa.Array, head: Head, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """For runs of 1, 2 and 3 words: the bucket of the run that begins at each word (-1 where the text ends before), and the
    n+1 offsets of the texts into the words."""
    data, starts, sizes, at = words_of(column)
    hashes = span_hashes(data, starts, starts + sizes, fold=False)
    slot, held = head.find(0, hashes, sizes)
    crc, spaced = head.tables[0][1][slot], head.spaced[slot]
    tail = np.flatnonzero(~held)
    crc[tail] = direct_states(data, starts[tail], sizes[tail])
    space = np.full(len(tail), zlib.crc32(b" "), np.uint32)
    spaced[tail] = moved_on(space, np.minimum(sizes[tail], LONG_WORD)) ^ crc[tail]  # those of long words are not used
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(starts))  # words of the text from here on
    modulo = np.uint32(buckets)
    out = [(crc % modulo).astype(np.int64)]
    if len(starts) > 1:
        pairs = joined_hashes(hashes, 2)
        slot, held = head.find(1, pairs)
        two = head.tables[1][1][slot]
        rest = np.flatnonzero(~held)
        two[rest] = after(crc[rest], spaced[rest + 1], sizes[rest + 1], data, starts[rest + 1])
        found = np.where(held, head.pair_buckets[slot], (two % modulo).astype(np.int64)) if buckets == BUCKETS else (two % modulo).astype(np.int64)
        out.append(np.append(np.where(left[:-1] >= 2, found, -1), -1))
        three = after(two[:-1], spaced[2:], sizes[2:], data, starts[2:])
        out.append(np.append(np.where(left[:-2] >= 3, (three % modulo).astype(np.int64), -1), [-1, -1]))
    return out, at


_FREQUENT = pa.schema([("pair", pa.bool_()), ("hash", pa.int64()), ("crc", pa.int64()), ("size", pa.int32()), ("n", pa.int64())])


def frequent_in(column: pa.Array) -> pa.RecordBatch:
    """Words and pairs that are one of HEAD_SHARE in these texts at least, with the CRC and size of their bytes."""
    data, starts, sizes, at = words_of(column)
    ends = starts + sizes
    words = span_hashes(data, starts, ends, fold=False)
    inner = np.ones(max(0, len(words) - 1), bool)
    inner[[i - 1 for i in at[1:-1].tolist() if 0 < i < len(words)]] = False
    own = np.flatnonzero(inner)  # words followed by another of their text
    parts = []
    for pair, hashes, place in ((False, words, None), (True, joined_hashes(words, 2)[own], own)):
        found, where, counts = np.unique(hashes, return_index=True, return_counts=True)
        keep = counts * HEAD_SHARE >= len(words)
        first = where[keep] if place is None else place[where[keep]]
        texts = [data[starts[i] : ends[i]].tobytes() + (b" " + data[starts[i + 1] : ends[i + 1]].tobytes() if pair else b"") for i in first.tolist()]
        parts.append(batch(_FREQUENT, pair=[pair] * len(texts), hash=found[keep].view(np.int64), crc=[zlib.crc32(t) for t in texts], size=[len(t) for t in texts], n=counts[keep]))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]


def frequent(rows: DataFrame) -> Head:
    """The head of all texts. A slice of some MB of text passes on what is so frequent in it, so what leaves a task and what
    reaches the driver is bounded by the share, not by the vocabulary; what a slice passes over counts as tail there."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                yield frequent_in(b.column("text"))

    found = mapped(rows.select("text"), run, "pair boolean, hash long, crc long, size int, n long")
    summed = staged(found.groupBy("pair", "hash").agg(F.min("crc").alias("crc"), F.max("size").alias("size"), F.sum("n").alias("n")), "frequent")
    total = summed.groupBy("pair").agg(F.sum("n").alias("total"))
    kept = summed.join(F.broadcast(total), "pair").where(F.col("n") * HEAD_SHARE >= F.col("total")).select("pair", "hash", "crc", "size", "n").toArrow()
    sides = []
    for pair in (False, True):
        t = kept.filter(pc.equal(kept["pair"], pair))
        sides.append({"hash": t["hash"].to_numpy().view(np.uint64), "crc": t["crc"].to_numpy().astype(np.uint32), "size": t["size"].to_numpy().astype(np.int64), "n": t["n"].to_numpy()})
    return Head(*sides)


def bucket_totals(rows: DataFrame, head: Broadcast, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket, counted in the tasks and summed."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                for found in feature_buckets(b.column("text"), head.value, buckets)[0]:
                    counts += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield batch(schema, bucket=some, n=counts[some])

    counted = mapped(rows.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return staged(counted, "bucket-totals")  # read twice


def gains(spark: SparkSession, ours: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, s, t, gain) of every bucket from the totals of the documents and of the target."""
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = each.join(ours.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    up = (F.col("t") + F.lit(1.0)) * F.lit(float(all_s + buckets))
    down = (F.col("s") + F.lit(1.0)) * F.lit(float(all_t + buckets))
    return both.withColumn("gain", F.floor(F.log(up / down) * F.lit(1000.0)).cast("long"))


def weights(rows: DataFrame, head: Broadcast, gain: Broadcast) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    buckets = len(gain.value)

    def run(batches):
        table = np.append(gain.value, 0)  # the last is read where a text ends before
        for whole in batches:
            for b in slices(whole, "text"):
                found, at = feature_buckets(b.column("text"), head.value, buckets)
                sums = np.zeros(len(at) - 1, np.int64)
                for x in found:
                    before = np.concatenate([[0], np.cumsum(table[x])])
                    sums += before[at[1:]] - before[at[:-1]]
                n = np.diff(at)
                features = sum(np.maximum(n - k, 0) for k in range(ORDER))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(features, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return mapped(rows, run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """Gumbel noise in thousandths from a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * F.lit(-1000.0)).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, and rank among those drawn (else null). `target` has a text
    column."""
    spark = docs.sparkSession
    rows, wanted = texts_of(docs), target.select(F.coalesce("text", F.lit("")).alias("text"))
    head = spark.sparkContext.broadcast(frequent(rows))
    table = gains(spark, bucket_totals(rows, head), bucket_totals(wanted, head)).select("bucket", "gain").toArrow().sort_by("bucket")
    gain = spark.sparkContext.broadcast(table["gain"].to_numpy())
    scored = staged(weights(rows, head, gain).withColumn("score", F.col("weight") + noise(seed)), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # rows that tie in everything may go either way: their place in the stored table only keeps them apart
    spread = able.withColumn("_place", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight"), F.col("_place")]
    ranked = with_row_number(spread, order).drop("_place").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op11(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    """Features, their CRC-32 by the byte step's linearity over bits, gains, scores and ranks."""
    bits = [1 << i for i in range(8)]
    step = " ".join(f", {int(byte_table()[b])} * ((xor(c, b) >> {i}) & 1))" for i, b in enumerate(bits))
    crc = "xor(" * 8 + "c >> 8" + step
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    return f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {found} AS w FROM documents),
wanted AS MATERIALIZED (SELECT {found} AS w FROM benchmark),
ours AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest({runs}) AS f FROM docs) GROUP BY doc_id, f),
theirs AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({runs}) AS f FROM wanted) GROUP BY f),
names AS (SELECT f FROM ours UNION SELECT f FROM theirs),
coded AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: {crc}), 4294967295) % {BUCKETS} AS bucket FROM names),
s AS (SELECT bucket, sum(n) AS s FROM ours JOIN coded USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM theirs JOIN coded USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), totals),
weighed AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM ours JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM docs d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= {LEAST_WORDS}),
number AS (SELECT count(*) * {PERCENT} // 100 AS drawn FROM ranked)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= drawn THEN place END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id), number"""


ORACLE_SQL = _oracle()
