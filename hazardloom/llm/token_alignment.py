"""Alignment of the tokens of two tokenizers over the same texts.

A text, with a space before it, is cut before each single space between two visible characters: neither tokenizer joins bytes
over such a cut, so both have a token end there and the stretches between are aligned on their own. A stretch seen before comes
from a cache of bounded size, which changes no result.

Within a stretch the libraries' own spans are coarse cuts: character offsets of `tokenizers`, byte spans of the pieces in the
protobuf of `sentencepiece` (return type `proto`, as the installed release no longer offers the immutable form). Where all characters are single
bytes they are the byte ends already. Elsewhere a token may hold part of a character, and a byte-fallback piece has an empty
span: there the decoded bytes of the tokens place the ends between the coarse cuts. Whether the decoded bytes are those of the
text is checked for every stretch; if one of a text differs, the text has no tokens.

The links of all documents are counted in the tasks and summed per pair of ids. Pairs that hold a 2**20th of all links at least,
so 2**20 pairs at most, and the highest count of each B id, so one row per entry of its vocabulary, are sent to all workers; the
links of other pairs are looked up in a join, where no pair is frequent.

Every token has a byte at least, so the tokens of one side that end at an offset are one; links and groups are equally many.

Defined results: null and empty texts have no tokens; texts of any length are taken whole; rows with equal ids stay separate and
count each; a null doc_id stays null; an empty table gives an empty one; other columns are neither read nor returned."""

from __future__ import annotations

import gc
import hashlib
import os
from array import array
from bisect import bisect_right
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.byte_bpe import CUT, bytes_by_id, evenly_spaced
from hazardloom.llm.common import load, mapped, slices, staged, text_bytes, texts_of, worker_state

CACHED = 450_000
CACHED_LENGTH = 48
LEARNED_AT_ONCE = 4_000
HEAD_PAIRS = 1 << 20
FLUSH = 4 << 20
MARKS = ",."
BLANK = "▁"  # fixed value: stands for a space in the pieces


def sums_by(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that have the given lengths."""
    before = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return before[ends] - before[ends - counts]


class Aligner:
    """Both tokenizers, and per stretch seen before its numbers of tokens and links, its groups and its links."""

    def __init__(self, json: bytes, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(json.decode())
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte_of = lambda i, piece: bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(BLANK, " ").encode()
        self.bytes = bytes_by_id(self.a.get_vocab()), [byte_of(i, p) for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(b) for b in table], np.int64) for table in self.bytes]
        self.kind = np.dtype("<u2" if max(map(len, self.bytes)) <= 1 << 16 else "<u4")
        #: Ids as they stand inside a group and at the end of its side.
        self.shown = [[np.array([f"{i}{mark}" for i in range(len(table))], object) for mark in marks] for table, marks in zip(self.bytes, (",|", ",;"), strict=True)]
        #: Whether pieces have blanks at their beginning only, which makes the cuts right for B as well.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        #: The alignment of a mark that follows letters: neither tokenizer joins it to them, so its group stands on its own.
        self.marks: dict[str, tuple[str, bytes]] = {}
        for mark in MARKS:
            a, b = self.a.token_to_id(mark), self.b.piece_to_id(mark)
            if a is not None and self.b.id_to_piece(b) == mark and not any(x.isalpha() and y == mark for p in pieces for x, y in pairwise(p)):
                self.marks[mark] = f"{a}|{b};", np.array([a, b], self.kind).tobytes()
        self.forget(0)

    def forget(self, kept: int) -> None:
        """Keeps the stretches learned first; they are the frequent ones."""
        if not kept:
            self.slot: dict[str, int] = {}
            self.groups: list[str] = []
            self.links: list[bytes] = []
            self.numbers = array("i"), array("i"), array("i")  # n_a (-1: the bytes differ), n_b, n_links
        while len(self.slot) > kept:
            self.slot.popitem()
        for x in (self.groups, self.links, *self.numbers):
            del x[kept:]

    def ends(self, side: int, ids: np.ndarray, counts: np.ndarray, coarse: np.ndarray, base: np.ndarray, ascii_: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: where all characters are single bytes the coarse cut, elsewhere the cut if the decoded bytes reach
        it, and the place they reach if it lies inside a character."""
        before = np.concatenate([[0], np.cumsum(self.sizes[side][ids])])
        first = np.cumsum(counts) - counts
        placed = before[1:] + np.repeat(base - before[first], counts)
        return np.where(np.repeat(ascii_, counts) | (coarse == placed), coarse, placed)

    def learn(self, keys: list[str]) -> None:
        """Aligns stretches, each a key after a space."""
        found = self.a.encode_batch([" " + k for k in keys], add_special_tokens=False)
        pieces = [y.pieces for y in self.b.encode(keys, return_type="proto", num_threads=1)]
        ids = [np.array(list(chain.from_iterable([e.ids for e in found])), np.int64), np.array([p.id for y in pieces for p in y], np.int64)]
        counts = [np.array([len(e) for e in found], np.int64), np.array([len(y) for y in pieces], np.int64)]
        whole = [b" " + k.encode() for k in keys]
        data, sizes = b"".join(whole), np.array([len(w) for w in whole], np.int64)
        base = np.cumsum(sizes) - sizes
        good = np.ones(len(keys), bool)
        for side in (0, 1):
            reached = sums_by(counts[side], self.sizes[side][ids[side]])
            good &= reached == sizes
            table = self.bytes[side]
            decoded = b"".join([table[i] for i in ids[side].tolist()])
            if decoded != data:
                begins = np.cumsum(reached) - reached
                good &= np.array([decoded[b : b + n] == w for b, n, w in zip(begins.tolist(), reached.tolist(), whole, strict=True)])
        ascii_ = np.array([k.isascii() for k in keys])
        # character offsets of A and byte spans of B as bytes of all stretches end to end
        letters = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        spans = np.array([o[1] for e in found for o in e.offsets], np.int64), np.array([p.end for y in pieces for p in y], np.int64)
        coarse = letters[np.minimum(np.repeat(np.searchsorted(letters, base), counts[0]) + spans[0], len(letters) - 1)], np.repeat(base + 1, counts[1]) + spans[1]
        ends = []
        for side in (0, 1):
            keep = np.repeat(good, counts[side])
            ends.append(self.ends(side, ids[side], counts[side], coarse[side], base, ascii_)[keep])
            ids[side] = ids[side][keep]
        at = np.minimum(np.searchsorted(ends[1], ends[0]), max(0, len(ends[1]) - 1))
        meets = ends[1][at] == ends[0] if len(ends[1]) else np.zeros(0, bool)
        common, partner = ends[0][meets], at[meets]
        last = np.zeros(len(ends[1]), bool)
        last[partner] = True
        shown = [np.where(m, self.shown[side][1][ids[side]], self.shown[side][0][ids[side]]) for side, m in ((0, meets), (1, last))]
        order = np.argsort(np.concatenate([2 * np.searchsorted(common, ends[0]), 2 * np.searchsorted(common, ends[1]) + 1]), kind="stable")
        texts = np.concatenate(shown)[order].tolist()
        links = np.stack([ids[0][meets], ids[1][partner]], axis=1).astype(self.kind).tobytes()
        owner = np.searchsorted(base, common, "left") - 1  # an end is above the base of its stretch
        n_links = np.bincount(owner, minlength=len(keys)) if len(keys) else np.zeros(0, np.int64)
        used = [np.where(good, c, 0) for c in counts]
        tokens, step = [0, *np.cumsum(used[0] + used[1]).tolist()], 2 * self.kind.itemsize
        edges = [0, *(step * np.cumsum(n_links)).tolist()]
        self.groups += ["".join(texts[a:b]) for a, b in zip(tokens[:-1], tokens[1:], strict=True)]
        self.links += [links[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for store, values in zip(self.numbers, (np.where(good, counts[0], -1), used[1], n_links), strict=True):
            store.extend(values.tolist())
        self.slot |= {k: n for n, k in enumerate(keys, len(self.slot))}

    def learn_all(self, keys: set[str]) -> int:
        """Aligns what is not known yet; stretches too long to keep come last, and their number is returned. Letters with a mark
        after them take the alignment of the letters."""
        marked = [k for k in keys if k[-1:] in self.marks and k[:-1].isalpha() and len(k) <= CACHED_LENGTH]
        plain = keys.difference(marked)
        plain.update(k for k in [k[:-1] for k in marked] if k not in self.slot)
        fresh = sorted(plain, key=len)
        short = bisect_right(fresh, CACHED_LENGTH, key=len)
        for n in range(0, short, LEARNED_AT_ONCE):
            self.learn(fresh[n : min(short, n + LEARNED_AT_ONCE)])
        for k in marked:
            n, (group, link) = self.slot[k[:-1]], self.marks[k[-1]]
            self.groups.append(self.groups[n] + group)
            self.links.append(self.links[n] + link)
            for store in self.numbers:
                store.append(store[n] + (self.numbers[0][n] >= 0))
            self.slot[k] = len(self.slot)
        for n in range(short, len(fresh), LEARNED_AT_ONCE):
            self.learn(fresh[n : n + LEARNED_AT_ONCE])
        return len(fresh) - short

    def stretches(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        return text.split(" ") if evenly_spaced(text) else [p[1:] for p in CUT.split(" " + text)]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[bytes]]:
        """Per text: (n_a, n_b, n_links) as a row, the groups, and the links as pairs of unsigned integers of `kind`."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects are made here, none in cycles
        try:
            cut = [self.stretches(t) for t in texts]
            long = self.learn_all(set().union(*cut).difference(self.slot))
            slot, groups, links = self.slot, self.groups, self.links
            places = [[slot[k] for k in keys] for keys in cut]
            flat = np.fromiter(chain.from_iterable(places), np.int64)
            sizes = np.array([len(p) for p in places], np.int64)
            each = [np.frombuffer(x, np.intc)[flat] if len(flat) else np.zeros(0, np.intc) for x in self.numbers]
            bad = sums_by(sizes, (each[0] < 0).astype(np.int64)) > 0
            numbers = np.stack([np.where(bad, 0, sums_by(sizes, x.astype(np.int64))) for x in each], axis=1)
            out = [("", b"") if b else ("".join([groups[i] for i in p])[:-1], b"".join([links[i] for i in p])) for p, b in zip(places, bad.tolist(), strict=True)]
            if long or len(slot) > CACHED:
                self.forget(CACHED // 2 if len(slot) - long > CACHED else len(slot) - long)
        finally:
            if collecting:
                gc.enable()
        return numbers, [g for g, _ in out], [x for _, x in out]


def aligner_of(sources: tuple[Broadcast, Broadcast]) -> Aligner:
    """The aligner of two broadcast files, made once per Python worker."""
    json, model = (s.value for s in sources)
    return worker_state((hash(json), hash(model)), lambda: Aligner(json, model))


def vocabularies(spark: SparkSession, json: str, model: str) -> tuple[Broadcast, Broadcast]:
    """Two vocabulary files of a few MB sent to all workers."""
    out = []
    for path in (json, model):
        with open(path, "rb") as f:
            out.append(spark.sparkContext.broadcast(f.read()))
    return tuple(out)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, links binary"


def aligned(docs: DataFrame, sources: tuple[Broadcast, Broadcast], groups: bool = False) -> DataFrame:
    """Per document: row (a number of its own), doc_id, n_a, n_b, n_links, groups_sha256 ('' without tokens), links (pairs of ids as
    little-endian unsigned integers, of 16 bits if both vocabularies fit, else 32) and, on request, groups: `a1,a2|b1;a3|b2,b3`."""

    def run(batches):
        aligner, row = aligner_of(sources), TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                numbers, shown, links = aligner.texts(b.column("text").to_pylist())
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown]
                columns = [pa.array(np.arange(row, row + len(shown))), b.column("doc_id"), *[pa.array(numbers[:, k], pa.int64()) for k in range(3)], pa.array(digests, pa.string()), pa.array(links, pa.binary())]
                row += len(shown)
                yield pa.RecordBatch.from_arrays(columns + [pa.array(shown, pa.string())] * groups, ["row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "links"] + ["groups"] * groups)

    return mapped(texts_of(docs), run, ALIGNED + ", groups string" * groups, state=True)


def link_kind(sources: tuple[Broadcast, Broadcast]) -> np.dtype:
    """The integers in which links are stored."""
    import sentencepiece
    from tokenizers import Tokenizer

    sizes = Tokenizer.from_str(sources[0].value.decode()).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_proto=sources[1].value).get_piece_size()
    return np.dtype("<u2" if max(sizes) <= 1 << 16 else "<u4")


def codes(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Links of a batch as a << 32 | b, and how many each row has."""
    data, bounds = text_bytes(column)
    pairs = np.frombuffer(data.tobytes(), kind).reshape(-1, 2).astype(np.int64)
    return (pairs[:, 0] << 32) | pairs[:, 1], np.diff(bounds) // (2 * kind.itemsize)


def pair_counts(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """(code, n): how many links of all documents hold each pair of ids linked; code is a << 32 | b."""

    def run(batches):
        held, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)], pa.int64())], ["code", "n"])

        for b in batches:
            part, _ = codes(b.column("links"), kind)
            held.append(part)
            size += len(part)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return mapped(rows.select("links"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def with_counts(rows: DataFrame, kind: np.dtype, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Adds n_best (links whose pair's count is the highest of its B id) and count_sum to stored rows of `aligned`."""
    spark = rows.sparkSession
    counts = staged(pair_counts(rows, kind), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // head_pairs))
    head = counts.where(F.col("n") >= least).toArrow()
    best = counts.groupBy(F.col("code").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("best")).toArrow()
    order = np.argsort(head["code"].to_numpy())
    most = np.zeros(1 + max([-1, *best["b"].to_pylist()]), np.int64)
    most[best["b"].to_numpy()] = best["best"].to_numpy()
    sent = spark.sparkContext.broadcast((head["code"].to_numpy()[order], head["n"].to_numpy()[order], most))
    kept = [c for c in rows.columns if c != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "links") + ", n_best long, count_sum long, rest array<long>"

    def run(batches):
        known, n, top = sent.value
        for b in batches:
            flat, sizes = codes(b.column("links"), kind)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            held = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            count = np.where(held, n[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            best = sums_by(sizes, (held & (count == top[flat & 0xFFFFFFFF])).astype(np.int64)) if len(flat) else np.zeros(len(sizes), np.int64)
            left = np.bincount(owner[~held], minlength=len(sizes))
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.array(flat[~held]), type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(best, pa.int64()), pa.array(sums_by(sizes, count), pa.int64()), rest], [*kept, "n_best", "count_sum", "rest"])

    looked = mapped(rows, run, schema)
    if least == 1:
        return looked.drop("rest")  # the head holds every pair
    looked = staged(looked, "looked-up")
    seldom = counts.where(F.col("n") < least).select("code", "n")
    highest = counts.groupBy(F.col("code").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("best"))
    seldom = seldom.join(F.broadcast(highest), F.col("code").bitwiseAND(0xFFFFFFFF) == F.col("b")).select("code", "n", (F.col("n") == F.col("best")).cast("long").alias("hit"))
    links = looked.select("row", F.explode("rest").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("times"))
    more = links.join(seldom, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("hit")).alias("more_best"))
    whole = looked.drop("rest").join(more, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_sum", "more_best")


def alignment(docs: DataFrame, sources: tuple[Broadcast, Broadcast], head_pairs: int = HEAD_PAIRS, groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_links, groups_sha256, n_best, count_sum and, on request, groups."""
    return with_counts(staged(aligned(docs, sources, groups), "aligned"), link_kind(sources), head_pairs).drop("row")


def op13(docs: DataFrame, sources: tuple[Broadcast, Broadcast]) -> DataFrame:
    return alignment(docs, sources).select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sources = vocabularies(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return op13(load(spark, sf_dir, "documents"), sources)
