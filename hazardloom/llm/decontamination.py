"""Benchmark items that occur in documents, exactly or with some words changed.

An item of n words occurs in a document if some window of it, of any number of words, is within k = n * percent / 100
word edits (insert, delete, replace) of it; such a window has n - k to n + k words. Words are folded A-Z and separated by blanks.

* Items of more than `PIECE` words are cut into pieces of two thirds of that at least. If an item is within the limit, so is one of its
  pieces, and mostly several; a window the size of a piece is looked for, then the whole item around it.
* The CGK walk reads a window word by word: step t writes the word under a pointer, which a random bit of (t, word) moves
  on or leaves. Two texts a few edits apart fall into step again, so their written runs differ in few places: edit distance
  has become Hamming distance.
* Bit sampling: a few places of the run form a key; windows and pieces with an equal key in any of several tables of several walks are
  candidates. Places lie in the part that the shortest piece of a length band fills. Walks are added to a band until, in a
  simulation with a fixed seed, pieces at the edit limit are found with the target recall, for replaced, inserted and deleted
  words each.
* Candidates of an item in a document are merged where they overlap. A stretch must hold enough of the item's words; then the
  least exact edit distance over all its windows is found bit-parallel, a word of the document at a time.

Windows are placed where a piece can begin: of n words with k edits, one of k + 1 parts is unchanged, so a window
without a run of n / (k + 1) words of the piece can't match, and such a run says where it begins, to k words. This loses no match.

Items are the stated query set: they go to the workers in blocks of bounded size, one block after another, each against all
documents; documents are read once a block and never shuffled. With several blocks the results of each are stored before the next
is sent.

Defined results: null, empty and short items (fewer than `least` words) match nothing; items with equal ids or texts are
separate items; a null or empty document matches nothing; of several closest windows the first that ends is told;
rows of equal ids stay separate; empty tables give no rows; `clean` keeps all columns, whatever their names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.common import free_names, joined_hashes, load, mapped, mix, slices, staged, text_key, texts_of, word_hashes

PERCENT = 20
LEAST = 8
BLOCK_BYTES = 16 << 20
PIECE = 32  # words
RECALL = 0.98  # of pieces at the edit limit, in the simulation
TRIALS = 150  # simulated pieces of each kind of edit
FIRST_WALKS = 4
MOST_WALKS = 16
TABLES = 5
SAMPLES = 2
BAND = 1.3
PAD = np.uint64(0x2545F4914F6CDD1D)
LONGEST_SEED = 4


@dataclass
class Rules:
    percent: int = PERCENT
    least: int = LEAST
    tables: int = TABLES
    samples: int = SAMPLES
    recall: float = RECALL

    def edits(self, n: int) -> int:
        return n * self.percent // 100

    def seed(self, n: int) -> int:
        """Length of a run that stays unchanged in any window within the edit limit."""
        return min(LONGEST_SEED, n // (self.edits(n) + 1))


def walk(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, steps: int, number: int) -> np.ndarray:
    """What the CGK walk writes from each begin on: one row of `steps` words; past its end a text is padding."""
    salts = mix(np.arange(steps, dtype=np.uint64) + np.uint64(number << 32))
    spot, out = begins.copy(), np.empty((len(begins), steps), np.uint64)
    for t in range(steps):
        inside = spot < ends
        out[:, t] = np.where(inside, words[np.minimum(spot, len(words) - 1)], PAD)
        spot += (mix(out[:, t] ^ salts[t]) & np.uint64(1)).astype(np.int64)
    return out


def band_of(n: int, least: int) -> int:
    return int(np.log(n / least) / np.log(BAND) + 1e-9)


def pieces_of(n: int) -> list[tuple[int, int]]:
    """An item's pieces as (begin, end): itself up to PIECE words, else equal parts of at most three quarters of that."""
    count = 1 if n <= PIECE else -(-n // (PIECE * 3 // 4))
    edges = [n * i // count for i in range(count + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def keys_of(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, steps: int, places: np.ndarray) -> list[np.ndarray]:
    """The sampled key of each text under each walk and table; places: walks x tables x samples."""
    out = []
    for w in range(len(places)):
        run = walk(words, begins, ends, steps, w)
        for t in range(places.shape[1]):
            key = np.full(len(begins), t, np.uint64)
            for place in places[w, t]:
                key = mix(key + run[:, place])
            out.append(key)
    return out


def edited(r: np.random.Generator, words: np.ndarray, k: int, kind: int) -> np.ndarray:
    """The words with k of them replaced (0), put in (1) or left out (2)."""
    fresh = r.integers(0, 2**63, k).astype(np.uint64)
    spots = np.sort(r.choice(len(words), k, replace=False))
    if kind == 0:
        out = words.copy()
        out[spots] = fresh
        return out
    return np.insert(words, spots, fresh) if kind == 1 else np.delete(words, spots)


_PLACES: dict[tuple, np.ndarray] = {}


def places_for(n: int, steps: int, rules: Rules, band: int) -> np.ndarray:
    """Walks x tables x samples places for pieces of up to n words: walks are added until the recall at the edit limit is met."""
    key = (n, steps, rules.percent, rules.tables, rules.samples, rules.recall, band)
    if key in _PLACES:
        return _PLACES[key]
    r, k = np.random.Generator(np.random.PCG64(band)), rules.edits(n)
    places = r.integers(0, steps, (MOST_WALKS, rules.tables, rules.samples))
    pieces = [r.integers(0, 2**63, n).astype(np.uint64) for _ in range(3 * TRIALS if k else 0)]
    found = np.zeros((len(pieces), MOST_WALKS), bool)
    if pieces:
        both = [x for i, piece in enumerate(pieces) for x in (piece, edited(r, piece, k, i % 3))]
        ends = np.cumsum([len(x) for x in both])
        keys = np.array(keys_of(np.concatenate(both), np.concatenate([[0], ends[:-1]]), ends, steps, places))
        found = (keys[:, ::2] == keys[:, 1::2]).reshape(MOST_WALKS, -1, len(pieces)).any(1).T
    walks = FIRST_WALKS
    while walks < MOST_WALKS and len(pieces) and min(found[kind::3, :walks].any(1).mean() for kind in range(3)) < rules.recall:
        walks += 1
    _PLACES[key] = places[:walks]
    return _PLACES[key]


class Index:
    """Items of a block and their pieces: seeds and sampled keys."""

    def __init__(self, ids: list, texts: list[str], rules: Rules):
        words, at = word_hashes(pa.array(texts, pa.string()))
        keep = [i for i in range(len(ids)) if at[i + 1] - at[i] >= rules.least]
        self.rules, self.ids = rules, [ids[i] for i in keep]
        self.items = [words[at[i] : at[i + 1]] for i in keep]
        cut = [(i, a, b) for i, item in enumerate(self.items) for a, b in pieces_of(len(item))]
        self.piece_item, self.piece_at = (np.array([c[k] for c in cut], np.int64) for k in (0, 1))
        pieces = [self.items[i][a:b] for i, a, b in cut]
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.item_sizes = np.array([len(x) for x in self.items], np.int64)
        self.item_edits = np.array([rules.edits(len(x)) for x in self.items], np.int64)
        self.masks: dict[int, dict[int, int]] = {}
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list] = {}
        for i, piece in enumerate(pieces):
            g = rules.seed(len(piece))
            by_size.setdefault(g, []).append((joined_hashes(piece, g), np.full(len(piece) - g + 1, i), np.arange(len(piece) - g + 1)))
        for g, found in by_size.items():
            grams, piece, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(grams, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[(grams >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[g] = grams[order], piece[order], offset[order], marks
        self.band = np.array([band_of(len(p), rules.least) for p in pieces], np.int64)
        self.bands = {int(b): np.flatnonzero(self.band == b) for b in np.unique(self.band)}
        self.steps = {b: max(rules.samples, int(1.5 * self.sizes[m].min())) for b, m in self.bands.items()}
        self.places = {b: places_for(int(self.sizes[m].max()), self.steps[b], rules, b) for b, m in self.bands.items()}
        if pieces:
            ends = np.cumsum(self.sizes)
            whole, begins = np.concatenate(pieces), ends - self.sizes
            self.keys = {b: keys_of(whole, begins[m], ends[m], self.steps[b], self.places[b]) for b, m in self.bands.items()}

    def windows(self, words: np.ndarray, doc_ends: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """By band, the begins of windows that seeds allow, as positions in the words."""
        found: dict[int, list[np.ndarray]] = {}
        for g, (grams, piece, offset, marks) in self.seeds.items():
            runs = joined_hashes(words, g)
            hit = np.flatnonzero(marks[(runs >> np.uint64(44)).astype(np.int64)])
            hit = hit[hit + g <= doc_ends[hit]]
            low, high = np.searchsorted(grams, runs[hit], "left"), np.searchsorted(grams, runs[hit], "right")
            sizes = high - low
            hit, low, sizes = hit[sizes > 0], low[sizes > 0], sizes[sizes > 0]
            row = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            spot = np.repeat(hit, sizes)
            for band in np.unique(self.band[piece[row]]).tolist():
                own = self.band[piece[row]] == band
                reach = self.rules.edits(int(self.sizes[self.bands[band]].max()))
                first = at[np.searchsorted(at, spot[own], "right") - 1]
                begin = np.unique(np.stack([spot[own] - offset[row[own]], first]), axis=1)
                spread = begin[0][:, None] + np.arange(-reach, reach + 1)
                # a window begins in the document of its seed, at its first word at the earliest
                spread = np.maximum(spread, begin[1][:, None])
                inside = spread < doc_ends[np.minimum(begin[1], len(words) - 1)][:, None]
                found.setdefault(band, []).append(np.unique(spread[inside]))
        return {b: np.unique(np.concatenate(x)) for b, x in found.items()}

    def candidates(self, words: np.ndarray, at: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, item, begin and end of stretches in which an item may occur; those of an item that overlap are one."""
        shift = int(self.item_sizes.max())
        wide = len(words) + shift + 1
        parts = [np.zeros(0, np.int64)]
        for band, begins in self.windows(words, doc_ends, at).items():
            members = self.bands[band]
            for key, own in zip(keys_of(words, begins, doc_ends[begins], self.steps[band], self.places[band]), self.keys[band], strict=True):
                order = np.argsort(own, kind="stable")
                ranked = own[order]
                low, high = np.searchsorted(ranked, key, "left"), np.searchsorted(ranked, key, "right")
                sizes = high - low
                row = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                piece, begin = members[order[row]], np.repeat(begins, sizes)
                doc = np.searchsorted(at, begin, "right") - 1
                # document, item and where the item would begin, as one number
                parts.append(np.unique((doc * len(self.items) + self.piece_item[piece]) * wide + begin - self.piece_at[piece] + shift))
        pair, start = np.divmod(np.unique(np.concatenate(parts)), wide)
        (doc, item), start = np.divmod(pair, len(self.items)), start - shift
        k = self.item_edits[item]
        low, high = np.maximum(start - 2 * k - 1, at[doc]), np.minimum(start + self.item_sizes[item] + 2 * k + 1, at[doc + 1])
        if not len(doc):
            return doc, item, low, high
        # stretches of an item in a document all have about its length, so the end before is the furthest so far
        top = np.maximum.accumulate(high + (doc * len(self.items) + item) * (len(words) + 1)) - (doc * len(self.items) + item) * (len(words) + 1)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > top[:-1])
        first = np.flatnonzero(new)
        return doc[first], item[first], low[first], np.maximum.reduceat(high, first)

    def mask(self, i: int) -> dict[int, int]:
        """Per word of an item the bits of its places."""
        if i not in self.masks:
            if len(self.masks) > 20_000:
                self.masks.clear()
            found: dict[int, int] = {}
            for n, w in enumerate(self.items[i].tolist()):
                found[w] = found.get(w, 0) | 1 << n
            self.masks[i] = found
        return self.masks[i]

    def search(self, words: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) to the fewest edits and the window's begin, in words of the document; at: offsets of the documents."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if not self.items or not len(words):
            return out
        doc_ends = np.repeat(at[1:], np.diff(at))
        held: tuple = (-1, -1)
        for doc, i, low, high in zip(*(x.tolist() for x in self.candidates(words, at, doc_ends)), strict=True):
            most = int(self.item_edits[i])
            best = out.get((doc, i), (most + 1, 0))
            if (low, high) != held:
                text, held = words[low:high].tolist(), (low, high)
                there = Counter(text)
            mask, n = self.mask(i), int(self.item_sizes[i])
            if sum(min(m.bit_count(), there.get(w, 0)) for w, m in mask.items()) < n - most:
                continue
            edits, end = closest_end(text, mask, n)
            if edits < best[0]:
                begin = window_begin(text[:end], self.items[i].tolist(), edits)
                out[doc, i] = (edits, low + begin - int(at[doc]))
        return out


def _steps(text: list[int], mask: dict[int, int], n: int, anchored: bool):
    """After each word of the text, the edit distance of the item's n words to the nearest run that ends there (anchored: to the
    whole text so far). A column of the table is two numbers of n bits, where it rises and where it falls."""
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = every, 0, n
    for w in text:
        eq = mask.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        rise = down | (every & ~(zero | up))
        fall = up & zero
        score += 1 if rise & top else -1 if fall & top else 0
        rise = (rise << 1 | anchored) & every
        fall = fall << 1 & every
        up = fall | (every & ~(zero | rise))
        down = rise & zero
        yield score


def closest_end(text: list[int], mask: dict[int, int], n: int) -> tuple[int, int]:
    """The least edit distance of the item to any run of the text, the empty one included, and where the first such run ends."""
    best, end = n, 0
    for j, score in enumerate(_steps(text, mask, n, False), 1):
        if score < best:
            best, end = score, j
    return best, end


def window_begin(text: list[int], item: list[int], edits: int) -> int:
    """Where the shortest run begins that ends with the text and has the given distance to the item."""
    mask: dict[int, int] = {}
    for n, w in enumerate(reversed(item)):
        mask[w] = mask.get(w, 0) | 1 << n
    for j, score in enumerate(_steps(text[::-1], mask, len(item), True), 1):
        if score == edits:
            return len(text) - j
    return len(text)


def _item_rows(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")


def block_count(items: DataFrame, block_bytes: int) -> int:
    size = _item_rows(items).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-size // block_bytes)


def block(items: DataFrame, n: int, count: int) -> tuple[list, list[str]]:
    """Ids and texts of the items of block n."""
    found = _item_rows(items).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == n).collect()
    return [r.item_id for r in found], [r.text for r in found]


def matches(docs: DataFrame, items: DataFrame, rules: Rules | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of (doc_id, item_id, edits, item_words, first_word): the closest window of each item in each document that holds it."""
    spark, rules = docs.sparkSession, rules or Rules()
    shape = "doc_id long, item_id long, edits int, item_words int, first_word long"

    def finder(sent):
        def run(batches):
            index = sent.value
            for whole in batches:
                for b in slices(whole, "text"):
                    found = index.search(*word_hashes(b.column("text")))
                    docs = b.column("doc_id").take(pa.array([d for d, _ in found], pa.int64()))
                    columns = [[index.ids[i] for _, i in found], [e for e, _ in found.values()], [len(index.items[i]) for _, i in found], [f for _, f in found.values()]]
                    made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs, *made], ["doc_id", "item_id", "edits", "item_words", "first_word"])

        return run

    return by_block(items, rules, block_bytes, lambda sent: mapped(texts_of(docs), finder(sent), shape)) or spark.createDataFrame([], shape)


def by_block(items: DataFrame, rules: Rules, block_bytes: int, find: Callable[[Broadcast], DataFrame]) -> DataFrame | None:
    """What `find` has of every block of items. Of several blocks each is stored, and its index released, before the next is sent."""
    sc, out = items.sparkSession.sparkContext, None
    count = block_count(items, block_bytes)
    for n in range(count):
        sent = sc.broadcast(Index(*block(items, n, count), rules))
        found = find(sent)
        if count > 1:
            found = staged(found, "found-in-block")
            sent.unpersist()
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, rules: Rules | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item occurs, with all columns. Items of one block are looked for as the rows pass; of several,
    the texts found are gathered as fingerprints first."""
    rules = rules or Rules()

    def bad_rows(index: Index, b: pa.RecordBatch) -> np.ndarray:
        bad = np.zeros(b.num_rows, bool)
        bad[[d for d, _ in index.search(*word_hashes(b.column("text")))]] = True
        return bad

    def keeper(sent):
        def run(batches):
            for whole in batches:
                for b in slices(whole, "text"):
                    yield b.filter(pa.array(~bad_rows(sent.value, b)))

        return run

    def finder(sent):
        def run(batches):
            for whole in batches:
                for b in slices(whole, "text"):
                    yield b.select(["_k1", "_k2"]).filter(pa.array(bad_rows(sent.value, b)))

        return run

    if block_count(items, block_bytes) <= 1:
        kept = by_block(items, rules, block_bytes, lambda sent: docs.mapInArrow(keeper(sent), docs.schema))
        return docs if kept is None else kept
    key = text_key(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *key)
    bad = by_block(items, rules, block_bytes, lambda sent: mapped(rows, finder(sent), "_k1 long, _k2 long")).distinct()
    own = free_names(docs, 2)
    bad = bad.toDF(*own)
    return docs.select("*", *[k.alias(n) for k, n in zip(key, own, strict=True)]).join(bad, own, "left_anti").select(*docs.columns)


def op6(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
