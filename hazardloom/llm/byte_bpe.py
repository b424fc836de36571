"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

Every byte is shown to the library as one printable character; the vocabulary's strings, turned
back by the reversed table, give each token's bytes, from which offsets and decoding follow. A
token may hold part of a character: offsets then name the character it lies in, and decoding
joins bytes before it reads characters.

Texts are cut before each single space that stands between two visible characters, around such a line
break, and before a comma or full stop after a letter. No match of the splitting pattern crosses such a
cut, so the distinct pieces of a batch are encoded on their own, many in one call, and those seen before
come from a cache (of bounded size; it changes no result). The ids of whole batches are put together as
arrays.

Defined results: a null or empty text has no tokens; texts of any length are encoded whole; rows
with equal ids stay separate rows; a null doc_id stays null; an empty table gives an empty one;
other columns, whatever their names, are neither read nor returned unless asked for in `keep`."""

from __future__ import annotations

import base64
import codecs
import os
import re
import string
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.common import load, mapped, slices, text_bytes, texts_of, worker_state

CUT = re.compile(r"(?<=\S)(?= \S)")
AFTER_SPACE = re.compile(r" \S(?:[^ ]*\S)?")
IN_LINE = re.compile(r"\S(?:[^\n]*\S)?")
ENDS = b",."
CACHED_PIECES = 1_000_000
LEARNED_AT_ONCE = 5_000
CACHED_LENGTH = 48


# White space other than the plain space, by any library's reading.
OTHER_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = np.isin(np.arange(256), list(f" {OTHER_BLANKS}".encode()))
WIDE_CODES = {n: np.array([int.from_bytes(c.encode()) for c in WIDE_BLANKS if len(c.encode()) == n], np.uint32) for n in (2, 3)}
LETTERS = np.isin(np.arange(256), list(string.ascii_letters.encode()))
UNEVEN = ["  ", *[" " + c for c in OTHER_BLANKS], *[c + " " for c in OTHER_BLANKS]]


def evenly_spaced(text: str) -> bool:
    """Whether every plain space stands between two visible characters."""
    if text[:1] == " " or text[-1:] == " " or any(u in text for u in UNEVEN):
        return False
    return text.isascii() or not any(c in text for c in WIDE_BLANKS)


def beside_wide_blank(data: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether the character before (or after) each place is a blank of more than one byte."""
    out = np.zeros(len(at), bool)
    some = np.flatnonzero(data[at - 1 if before else at + 1] >= 0x80)
    for n, codes in ((2, WIDE_CODES[2]), (3, WIDE_CODES[3])):
        first = at[some] - n if before else at[some] + 1
        fits = (first >= 0) & (first + n <= len(data))
        code = np.zeros(int(fits.sum()), np.uint32)
        for i in range(n):
            code = code << np.uint32(8) | data[first[fits] + i]
        out[some[fits]] |= np.isin(code, codes)
    return out


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start: at every text that isn't empty; before a single space between visible characters; before and
    after such a line break; before a comma or full stop after a letter from A to z or of Latin-1."""
    marks = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        inner = np.ones(len(data), bool)
        inner[0] = inner[-1] = False
        inner[bounds[:-1][bounds[:-1] < len(data)]] = False
        inner[bounds[1:][bounds[1:] > 0] - 1] = False
        for blank in (32, 10):
            at = np.flatnonzero((data == blank) & inner)
            at = at[~(BLANKS[data[at - 1]] | BLANKS[data[at + 1]])]
            at = at[~(beside_wide_blank(data, at, True) | beside_wide_blank(data, at, False))]
            marks[at] = True
            if blank == 10:
                marks[at + 1] = True
        at = np.flatnonzero((data == ENDS[0]) | (data == ENDS[1]))
        at = at[at > 1]
        last = data[at - 1]
        marks[at[LETTERS[last] | (data[at - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]] = True
    marks[bounds[:-1]] = True
    return np.flatnonzero(marks[:-1])


def with_room(values: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer one that begins with it, with room for n values."""
    return values if len(values) >= n else np.concatenate([values, np.zeros(max(n, len(values) * 3 // 2) - len(values), values.dtype)])


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = [""] * 256
    for b in visible:
        table[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if not table[b]):
        table[b] = chr(256 + n)
    return table


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge gives this one: merging its bytes by rank with only lower ranks."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            raise ValueError(f"{token!r} can't be made of lower ranks")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def bytes_by_id(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of every token by the reversed table; a string that is not in it stands for itself."""
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * (1 + max(vocab.values(), default=-1))
    for text, i in vocab.items():
        out[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
    return out


def packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Ids of texts, end to end, as a binary column: little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(4 * at), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


class Codec:
    """A tokenizer of the library with a piece cache, and its tokens' bytes by id. What a text holds of the strings of special tokens
    is read as the library reads it by default: a file in its format names such tokens, ranks name none."""

    def __init__(self, tokenizer, cached: int = CACHED_PIECES):
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizer
        self.token_bytes = bytes_by_id(tokenizer.get_vocab())
        self.token_lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        #: Tokens that begin with a space, and those that a line break alone gives.
        self.spaced = np.array([b[:1] == b" " for b in self.token_bytes], bool)
        self.line = self._ids("\n")
        #: Rows of the pieces known, in the order in which they came; row i has the ids from begin[i] to begin[i + 1].
        self.known: dict[bytes, int] = {}
        self.flat, self.begin = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64)

    @classmethod
    def from_ranks(cls, data: bytes, pattern: str) -> Codec:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, shown = read_ranks(data), byte_characters()
        show = lambda token: "".join(shown[b] for b in token)
        merges = [tuple(map(show, _halves(t, ranks))) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
        tokenizer = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        return cls(tokenizer)

    @classmethod
    def from_json(cls, data: bytes) -> Codec:
        from tokenizers import Tokenizer

        return cls(Tokenizer.from_str(data.decode()))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and how many each has; the library gets the pieces one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.array(list(map(len, found)), np.int64)

    def _after_spaces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that have one space, in front: in one text, a token that begins with a space begins a piece."""
        ids = self._ids("".join(pieces))
        starts = np.flatnonzero(self.spaced[ids])
        return (ids, np.diff(starts, append=len(ids))) if len(starts) == len(pieces) else self._each(pieces)

    def _in_lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces without line breaks or outer blanks: in one text, a line each."""
        ids = self._ids("\n".join(pieces))
        breaks = np.flatnonzero(ids == self.line[0]) if len(self.line) == 1 else self.line
        if len(breaks) != len(pieces) - 1:
            return self._each(pieces)
        return np.delete(ids, breaks), np.diff(breaks, prepend=-1, append=len(ids)) - 1

    def _add(self, pieces: list[bytes]) -> None:
        """Makes rows of pieces that are not known."""
        kinds: tuple[list[bytes], ...] = ([], [], [])
        for p in pieces:
            text = p.decode()
            kinds[0 if AFTER_SPACE.fullmatch(text) else 1 if IN_LINE.fullmatch(text) else 2].append(p)
        for found, encoded in zip(kinds, (self._after_spaces, self._in_lines, self._each), strict=True):
            for at in range(0, len(found), LEARNED_AT_ONCE):
                some = found[at : at + LEARNED_AT_ONCE]
                ids, sizes = encoded([p.decode() for p in some])
                n, used = len(self.known), int(self.begin[len(self.known)])
                self.flat = with_room(self.flat, used + len(ids))
                self.begin = with_room(self.begin, n + len(some) + 1)
                self.flat[used : used + len(ids)] = ids
                self.begin[n + 1 : n + 1 + len(some)] = used + np.cumsum(sizes)
                self.known.update(zip(some, range(n, n + len(some)), strict=True))

    def _keep(self, n: int) -> None:
        """Forgets all but the first n rows."""
        while len(self.known) > n:
            self.known.popitem()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the n+1 offsets of the texts into them."""
        data, bounds = text_bytes(texts)
        starts = piece_starts(data, bounds)
        edges = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        row_of = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(row_of < 0)
        fresh = [distinct[i] for i in missing.tolist()]
        self._add([p for p in fresh if len(p) <= CACHED_LENGTH])
        short = len(self.known)
        self._add([p for p in fresh if len(p) > CACHED_LENGTH])
        row_of[missing] = [self.known[p] for p in fresh]
        rows = row_of[pieces.indices.to_numpy()]
        first = self.begin[rows]
        sizes = self.begin[rows + 1] - first
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        # frequent pieces came first: the later half goes
        self._keep(short if short <= self.cached else self.cached // 2)
        return ids, np.concatenate([np.zeros(1, np.int64), ends])[np.searchsorted(starts, bounds)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        return packed(*self.encode_column(pa.array(texts, pa.string()))).to_pylist()

    def byte_starts(self, ids: bytes) -> np.ndarray:
        ends = np.cumsum(self.token_lengths[np.frombuffer(ids, "<u4")])
        return np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])

    def character_spans(self, ids: bytes, text: str) -> list[tuple[int, int]]:
        """Per token the characters it touches, end exclusive; a split character is in several spans."""
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
        starts = self.byte_starts(ids)
        return [(int(at[s]), int(at[s + n - 1]) + 1) for s, n in zip(starts, self.token_lengths[np.frombuffer(ids, "<u4")], strict=True)]

    def token_texts(self, ids: bytes) -> list[str]:
        """Per token the characters it completes: those of a split character come with its last token."""
        read = codecs.getincrementaldecoder("utf-8")("replace")
        tokens = [self.token_bytes[i] for i in np.frombuffer(ids, "<u4")]
        out = [read.decode(t) for t in tokens]
        if out:
            out[-1] += read.decode(b"", final=True)
        return out


def codec_of(source: tuple) -> Codec:
    """The codec of (broadcast file, pattern or None), made once per Python worker."""
    file, pattern = source
    make = lambda: Codec.from_json(file.value) if pattern is None else Codec.from_ranks(file.value, pattern)
    return worker_state((hash(file.value), pattern), make)


def token_table(source: tuple) -> list[bytes]:
    """Bytes by id, without making an encoder."""
    file, pattern = source
    if pattern is None:
        return codec_of(source).token_bytes
    shown = byte_characters()
    return bytes_by_id({"".join(shown[b] for b in t): r for t, r in read_ranks(file.value).items()})


def vocabulary(spark: SparkSession, path: str, pattern: str | None = None) -> tuple:
    """A vocabulary file of a few MB sent to all workers: ranks with their pattern, or the library's own format."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern


def encode(docs: DataFrame, vocab: tuple, offsets: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) and, on request, `spans`: per token
    the first and the end character that it touches."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())] + ([("spans", pa.list_(pa.list_(pa.int32())))] if offsets else []))

    def run(batches):
        codec = codec_of(vocab)
        for whole in batches:
            for b in slices(whole, "text"):
                ids = packed(*codec.encode_column(b.column("text")))
                columns = [b.column("doc_id"), ids]
                if offsets:
                    pairs = zip(ids.to_pylist(), b.column("text").to_pylist(), strict=True)
                    columns.append(pa.array([codec.character_spans(i, t) for i, t in pairs], schema.field("spans").type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return mapped(texts_of(docs), run, "doc_id long, ids binary" + ", spans array<array<int>>" * offsets, state=True)


def decode(rows: DataFrame, vocab: tuple) -> DataFrame:
    """Adds `decoded`, the bytes of each row's ids (null ids: none); cast it to string for the text."""
    schema = "doc_id long, ids binary, decoded binary"

    def run(batches):
        table = token_table(vocab)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                decoded = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return mapped(rows.select("doc_id", "ids"), run, schema, state=True)


def digests(rows: DataFrame, *more: str) -> DataFrame:
    """Per decoded row the number of tokens and digests of its ids and bytes."""
    return rows.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op4(docs: DataFrame, vocab: tuple) -> DataFrame:
    return digests(decode(encode(docs, vocab), vocab))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op4(load(spark, sf_dir, "documents"), vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
