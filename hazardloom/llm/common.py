"""Helpers shared by the operators: staged tables, byte buffers of text columns, word hashes, repeated-hash bitmaps.

Text columns reach Python as Arrow batches; the helpers work on their UTF-8 bytes with numpy,
so no per-word Python objects are made. Hashes have 64 bits and are the same in every process."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.session import shared_path

CHUNK = 1 << 18
END = np.uint64(0xE14D0C5A9B7F2D31)
_BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED_CODES = BYTE_CODES[_FOLD]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: later steps start from stored data."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *more: Column | str, text: str = "text") -> DataFrame:
    """doc_id, text (null as empty) and the columns asked for; all other columns are left unread."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that the table doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_own{i}" for i in range(n + len(taken))) if x not in taken][:n]


def bitmap_bits(rows: DataFrame, text: str, bytes_per_bit: int, most: int = 30) -> int:
    """Size of a bitmap that follows the amount of text up to 2**most bits, which bounds what is sent to workers."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(most, max(20, (size // bytes_per_bit).bit_length()))


def text_key(text: Column) -> list[Column]:
    """128-bit fingerprint of a text in two columns; equal texts have equal results whatever their ids."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("_k2")]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession) -> int:
    """Power of two of hash ranges, twice the shuffle partitions at least."""
    return 1 << max(5, (2 * shuffle_partitions(spark) - 1).bit_length())


_STATE: dict = {}


def worker_state(key: Hashable, make: Callable):
    """What a Python worker keeps from task to task, such as a tokenizer with its cache. It holds one such state at a time."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def tidy() -> None:
    """Gives free memory back: workers live on after their task, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, state: bool = False) -> DataFrame:
    """Batches through fn. A worker drops the state of earlier stages unless these tasks use it."""

    def run(batches):
        if not state:
            _STATE.clear()
        yield from fn(batches)
        tidy()

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and its n+1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(columns: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part holds about `most` bytes of text; a longer text is a part of its own."""
    _, bounds = text_bytes(columns.column(column))
    at = 0
    while at < columns.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield columns.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 2)
        _POWERS[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)]
    return _POWERS[0], _POWERS[1]


def word_spans(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n+1 offsets of the texts into the words."""
    inside = ~blank[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1][bounds[1:-1] < len(data)]
    first[cuts] = inside[cuts]
    cuts = bounds[1:-1][bounds[1:-1] > 0] - 1
    last[cuts] = inside[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of each byte span (A-Z folded to a-z on request); spans rise and do not overlap."""
    codes = _FOLDED_CODES if fold else BYTE_CODES
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, origin + CHUNK, "right")))
        length = int(ends[end - 1] - origin)
        up, down = powers(length + 1)
        sums = np.zeros(length + 1, np.uint64)
        np.cumsum(codes[data[origin : origin + length]] * up[:length], out=sums[1:])
        s, e = starts[at:end] - origin, ends[at:end] - origin
        out[at:end] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = end
    return mix(out)


def word_hashes(column: pa.Array, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of every text, and the n+1 offsets of the texts into them."""
    data, bounds = text_bytes(column)
    starts, ends, at = word_spans(data, bounds, blank)
    return span_hashes(data, starts, ends), at


_TURNS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def joined_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, whatever text they are in."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out += words[i : i + len(out)] * _TURNS[i]
    return mix(out)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Per text its sorted distinct n-word shingles; a text of fewer words has its whole sequence as one."""
    words, at = word_hashes(column)
    runs = joined_hashes(words, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield joined_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def partial_rows(hashes: np.ndarray, repeated: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """Sorted distinct hashes cut by their top bits: bucket, hashes seen once, hashes known to be repeated."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for b in range(buckets):
        part, twice = hashes[edges[b] : edges[b + 1]], repeated[edges[b] : edges[b + 1]]
        if len(part):
            rows.append((b, part[~twice].tobytes(), part[twice].tobytes()))
    return rows


_PARTIAL = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def _flush(parts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
    rows = partial_rows(hashes, counts > 1, buckets)
    return batch(_PARTIAL, bucket=[r[0] for r in rows], once=[r[1] for r in rows], more=[r[2] for r in rows])


def repeated_bitmap(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Bitmap of 2**bits bits with a one for every hash that occurs at least twice over all rows.

    Each task sends a hash once however often it holds it, so a hash that half of all rows share
    costs one entry per task. The bitmap's size is fixed by `bits`: more data gives more false
    ones, never a missing one, and it is all that reaches the driver."""
    spark = rows.sparkSession
    buckets = buckets_for(spark)
    width = bits - (buckets.bit_length() - 1)

    def partial(batches):
        kept, size = [], 0
        for b in batches:
            for h in hashes(b):
                kept.append(h)
                size += len(h)
                if size > 3 << 20:
                    yield _flush(kept, buckets)
                    kept, size = [], 0
        if size:
            yield _flush(kept, buckets)

    def segment(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table.column("once").to_pylist()), np.uint64)
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint64)
        # a hash sent once by one task and as repeated by another is in `more` already
        found = np.sort(once)
        twice = np.concatenate([found[1:][found[1:] == found[:-1]], more])
        spots = np.unique((twice >> np.uint64(64 - bits)) & np.uint64((1 << width) - 1))
        marks = np.zeros(1 << width, np.uint8)
        marks[spots.astype(np.int64)] = 1
        packed = np.packbits(marks, bitorder="little").tobytes()
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    parts = mapped(rows, partial, "bucket int, once binary, more binary").groupBy("bucket").applyInArrow(segment, "bucket int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = (1 << width) // 8
    for row in parts.collect():
        out[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash has its bit set."""
    spot = hashes >> np.uint64(64 - bits)
    return (bitmap[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
