"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `length` bytes; suffixes that stay equal to that depth
are exactly the repeated windows, in whatever documents they start.

The passes, most significant digit first:

* The first digit is content-defined: the gram with the smallest hash in the window, and its place
  in it. Equal windows have equal first digits, and neighbouring windows mostly share one, so a
  run of windows travels as one stretch of text. A bitmap of fixed size, made from all
  documents, holds the grams that occur twice; windows whose gram occurs once are unique and go no further.
* The stretches are dealt out by first digit. In each bucket further passes compare `DIGIT` bytes
  at a time; after each, suffixes alone in their group drop out.

Equal stretches of one task are settled there and sent once, so a passage that a third of all documents
share costs one stretch per task and not one per document. Windows found to be repeated return
as intervals per document, and a join with the documents takes the covered bytes out.

Defined results: a null or empty text stays so and loses nothing; texts shorter than `length`
lose nothing; rows with equal ids are separate texts, and equal rows are copies of each other, so that all their
bytes go; an empty table gives an empty one; other columns are kept by `remove` and their names
may not start with `_sd_`. Windows are judged on the input. A cut may fall inside a character: the bytes left
are returned as binary, and `cleaned` reads them as text with broken characters replaced."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.llm.common import BYTE_CODES, bitmap_bits, buckets_for, load, mapped, marked, mix, powers, repeated_bitmap, slices, text_bytes

LENGTH = 200
GRAM = 24
DIGIT = 40
BYTES_PER_BIT = 64  # of the bitmap of repeated grams
CHUNK = 1 << 18
_PLACE = 22
_SPREAD = np.uint64(0x9FB21C651E98DF25)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from every position on."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(data) - n + 1])


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from running minima of blocks in both directions."""
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def window_runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Runs of windows that share their smallest gram, chunk by chunk: first window, last window, place
    of the gram, hash of the gram; places count from the start of the data."""
    w = length - gram + 1
    for origin in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[origin : origin + CHUNK + length - 1]
        n = len(part) - length + 1
        grams = rolling(part, gram)
        low = np.uint64((1 << _PLACE) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        at = (_window_minimum(keys, w) & low).astype(np.int64)
        inner = np.zeros(n + 1, np.int32)  # windows that would cross into the next text
        edges = bounds[1:-1][(bounds[1:-1] > origin) & (bounds[1:-1] < origin + len(part))] - origin
        np.add.at(inner, np.clip(edges - length + 1, 0, n), 1)
        np.add.at(inner, np.clip(edges, 0, n), -1)
        good = np.cumsum(inner[:-1]) == 0
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~good[:-1]
        starts = np.flatnonzero(new & good)
        if not len(starts):
            continue
        stop = np.ones(n, bool)
        stop[:-1] = new[1:] | ~good[1:]
        ends = np.flatnonzero(stop & good)
        # smallest hashes are small: spread anew, or they would all fall in the first buckets
        yield starts + origin, ends + origin, at[starts] + origin, mix(grams[at[starts]] ^ _SPREAD)


def _row_keys(docs: DataFrame, text: str) -> DataFrame:
    """Rows by a fingerprint of id and text, under names of their own."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_sd_k1": F.xxhash64(F.lit("a"), "doc_id", value), "_sd_k2": F.xxhash64(F.lit("b"), value, "doc_id")})


_SENT = pa.schema(
    [("bucket", pa.int32()), ("gram", pa.int64()), ("lead", pa.int32()), ("more", pa.bool_()), ("stretch", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]
)
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte stretches as one binary column."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    spots = np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - ends[:-1], sizes)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[spots])])


def _send(b: pa.RecordBatch, bitmap: np.ndarray, buckets: int, length: int, gram: int, bits: int):
    data, bounds = text_bytes(b.column("_text"))
    keys = [b.column(k).to_numpy() for k in ("_sd_k1", "_sd_k2")]
    for first, last, at, grams in window_runs(data, bounds, length, gram):
        keep = marked(bitmap, grams, bits)
        first, last, at, grams = (x[keep] for x in (first, last, at, grams))
        if not len(first):
            continue
        # equal stretches under equal first digits are copies of each other: one goes on for all of them
        whole = rolling(data[first[0] : last[-1] + length], length)
        ends = mix(whole[first - first[0]] + mix(whole[last - first[0]] + ((at - first) << 32 | (last - first)).astype(np.uint64)))
        _, one, group, count = np.unique(ends, return_index=True, return_inverse=True, return_counts=True)
        doc = np.searchsorted(bounds, first, "right") - 1
        settled = count[group] > 1
        sent = np.zeros(len(first), bool)
        sent[one] = True
        bucket = (grams >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int32)
        # settled runs that follow each other return as one interval
        follows = settled[1:] & settled[:-1] & (first[1:] == last[:-1] + 1) & (doc[1:] == doc[:-1])
        opens, closes = settled.copy(), settled.copy()
        opens[1:] &= ~follows
        closes[:-1] &= ~follows
        for rows, until, ship in ((np.flatnonzero(sent),) * 2 + (True,), (np.flatnonzero(opens), np.flatnonzero(closes), False)):
            n = len(rows)
            if not n:
                continue
            nothing = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[rows]),
                    pa.array(grams[rows].view(np.int64)),
                    pa.array((at[rows] - first[rows]).astype(np.int32)),
                    pa.array(settled[rows]),
                    _take(data, first[rows], last[rows] - first[rows] + length) if ship else nothing,
                    pa.array(keys[0][doc[rows]]),
                    pa.array(keys[1][doc[rows]]),
                    pa.array(first[rows] - bounds[doc[rows]]),
                    pa.array(last[until] - bounds[doc[rows]]),
                ],
                schema=_SENT,
            )


def _digits(data: np.ndarray, digit: int) -> np.ndarray:
    out = np.zeros(len(data), np.uint64)
    for origin in range(0, max(1, len(data) - digit + 1), CHUNK):
        part = data[origin : origin + CHUNK + digit - 1]
        if len(part) >= digit:
            out[origin : origin + len(part) - digit + 1] = rolling(part, digit)
    return out


def equal_suffixes(data: np.ndarray, suffixes: np.ndarray, groups: np.ndarray, depths: list[int], digit: int) -> np.ndarray:
    """Which suffixes equal another one of their group to the last depth: radix passes over the digits
    at the given depths, each over those that are still with others."""
    digits = _digits(data, digit)
    live = np.arange(len(suffixes))
    for depth in depths:
        keys = mix(groups + digits[suffixes[live] + depth])
        order = np.argsort(keys)
        ranked = keys[order]
        with_next = ranked[1:] == ranked[:-1]
        together = np.zeros(len(ranked), bool)
        together[1:] |= with_next
        together[:-1] |= with_next
        live, groups = live[order[together]], ranked[together]
    out = np.zeros(len(suffixes), bool)
    out[live] = True
    return out


def _sort_bucket(table: pa.Table, length: int, digit: int) -> pa.Table:
    table = table.combine_chunks()
    known = table.column("stretch").is_null().to_numpy()
    settled = table.filter(pa.array(known)).select(["k1", "k2", "first", "last"])
    table = table.filter(pa.array(~known))
    n = table.num_rows
    if not n:
        return settled.cast(_FOUND)
    stretches = table.column("stretch").combine_chunks()
    data = np.frombuffer(b"".join(stretches.to_pylist()), np.uint8)
    first, last = (table.column(k).to_numpy() for k in ("first", "last"))
    windows = last - first + 1
    begins = np.concatenate([[0], np.cumsum(windows + length - 1)[:-1]])
    ends = np.cumsum(windows)
    owner = np.repeat(np.arange(n), windows)
    step = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
    lead = table.column("lead").to_numpy().astype(np.int64)[owner] - step
    groups = mix(table.column("gram").to_numpy().view(np.uint64)[owner] + lead.astype(np.uint64))
    depths = [*range(0, length - digit, digit), length - digit]
    hit = equal_suffixes(data, begins[owner] + step, groups, depths, digit) & ~table.column("more").to_numpy()[owner]
    begin, stop = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    stop[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(stop)
    keys = [table.column(k).to_numpy()[owner[a]] for k in ("k1", "k2")]
    found = pa.table([pa.array(x) for x in (*keys, first[owner[a]] + step[a], first[owner[b]] + step[b])], schema=_FOUND)
    return pa.concat_tables([settled.cast(_FOUND), found])


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digit: int = DIGIT, bits: int | None = None, text: str = "text") -> DataFrame:
    """Intervals of starts of repeated windows: row fingerprint (k1, k2), first and last start in bytes."""
    if not gram <= length or not digit <= length:
        raise ValueError("grams and digits are parts of the window")
    spark = docs.sparkSession
    rows = _row_keys(docs, text).where(F.octet_length(text) >= length).select("_sd_k1", "_sd_k2", F.col(text).alias("_text"))
    buckets = 4 * buckets_for(spark)
    bits = bits or bitmap_bits(rows, "_text", BYTES_PER_BIT)

    def grams_of(whole):
        for b in slices(whole, "_text"):
            data, bounds = text_bytes(b.column("_text"))
            for _, _, at, grams in window_runs(data, bounds, length, gram):
                _, one = np.unique(at, return_index=True)
                yield grams[one]

    seen = spark.sparkContext.broadcast(repeated_bitmap(rows.select("_text"), grams_of, bits))

    def send(batches):
        for whole in batches:
            for b in slices(whole, "_text"):
                yield from _send(b, seen.value, buckets, length, gram, bits)

    schema = "bucket int, gram long, lead int, more boolean, stretch binary, k1 long, k2 long, first long, last long"
    return (
        mapped(rows, send, schema)
        .groupBy("bucket")
        .applyInArrow(lambda table: _sort_bucket(table, length, digit), "k1 long, k2 long, first long, last long")
    )


_REMOVED = "struct<kept: binary, n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string>"


def covered(intervals: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs, end exclusive, of windows given as intervals of starts."""
    out: list[list[int]] = []
    for first, last in sorted(intervals):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, length: int = LENGTH, text: str = "text", whole_characters: bool = False, **how) -> DataFrame:
    """All rows and columns of docs, and `_sd_kept` (bytes left; with `whole_characters` without the bytes of characters that a cut
    went through), `_sd_n_bytes`, `_sd_n_removed`, `_sd_n_spans`, `_sd_kept_sha256`."""
    found = repeated_windows(docs, length, text=text, **how).distinct()
    lists = found.groupBy(F.col("k1").alias("_sd_k1"), F.col("k2").alias("_sd_k2")).agg(F.collect_list(F.struct("first", "last")).alias("_sd_found"))
    rows = _row_keys(docs, text).join(lists, ["_sd_k1", "_sd_k2"], "left").drop("_sd_k1", "_sd_k2")
    results = {"kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def cut(batches):
        for whole in batches:
            for b in slices(whole, text):
                data, bounds = text_bytes(b.column(text))
                out = []
                for a, e, found in zip(bounds[:-1].tolist(), bounds[1:].tolist(), b.column("_sd_found").to_pylist(), strict=True):
                    spans = covered([(x["first"], x["last"]) for x in found or ()], length)
                    edges = [0, *[x for span in spans for x in span], e - a]
                    kept = b"".join(data[a + x : a + y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                    shown = kept.decode("utf-8", "ignore").encode() if whole_characters and spans else kept
                    out.append((shown, e - a, e - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
                columns = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "_sd_found"]
                names = [n for n in b.schema.names if n != "_sd_found"]
                made = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(results.values())]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*names, *["_sd_" + k for k in results]])

    kinds = {"kept": "binary", "kept_sha256": "string"}
    schema = T.StructType(list(docs.schema.fields))
    for k in results:
        schema = schema.add("_sd_" + k, kinds.get(k, "long"))
    return rows.mapInArrow(cut, schema)


def cleaned(docs: DataFrame, length: int = LENGTH, text: str = "text", **how) -> DataFrame:
    """docs with the repeated bytes taken out of the text; a null text stays null. Columns may have any names."""
    names = docs.columns
    inner = docs.toDF(*[n if n in ("doc_id", text) else f"{text}{i}" for i, n in enumerate(names)])
    rows = remove(inner, length, text, whole_characters=True, **how)
    left = F.when(F.col(text).isNotNull(), F.col("_sd_kept").cast("string"))
    return rows.withColumn(text, left).select(*inner.columns).toDF(*names)


def op7(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document what was removed, and a digest of the bytes left."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove(rows, length).select("doc_id", *[F.col("_sd_" + k).alias(k) for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(load(spark, sf_dir, "documents"))
