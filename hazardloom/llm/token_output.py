"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by ranges of doc_id and sorted; each task joins its documents' ids, with an
end id after each, into one run, cuts it into sequences of `length` ids and writes them with their
masks as fixed-size lists, `ROWS` sequences a batch. Every batch but the last is full, so the place of
any id follows from its number, and a memory-mapped file gives it without copying. The index of
documents (file, place, number of ids) is a table of its own, written by the same tasks.

A file gets its final name when it is whole, and the name holds the attempt, so a task that runs again
or twice never damages a file that the index names: the index is read for the attempts that Spark took.

Defined results: the string of a special token in a text becomes its id, as the library has it; a null or empty text is its end id alone; rows with equal ids are ordered by text; a
null doc_id comes first; an empty table gives no file and no rows; the last sequence of a file is
filled up with the end id under a false mask; other columns are neither read nor returned."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardloom.llm.byte_bpe import codec_of, vocabulary
from hazardloom.llm.common import load, mapped, shuffle_partitions, slices, texts_of
from hazardloom.session import shared_path

ROWS = 256
READ_IDS = 1 << 20
INDEX = "file int, path string, doc_id long, place long, n_tokens long"
FIELDS = pa.schema([("file", pa.int32()), ("path", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64())])
INDEX_ROWS = 1 << 17


def file_system(uri: str):
    """The file system of a path in the shared folder, and the path in it."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Collects ids and writes full batches of sequences."""

    def __init__(self, sink, length: int, end_id: int, wide: bool):
        self.length, self.end_id, self.dtype = length, end_id, np.uint32 if wide else np.uint16
        ids = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.held, self.size, self.place = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> int:
        place = self.place
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        self.place += len(ids)
        step = self.length * ROWS
        if self.size >= step:
            run = np.concatenate(self.held)
            full = len(run) // step * step
            for at in range(0, full, step):
                self._write(run[at : at + step], step)
            self.held, self.size = [run[full:]], len(run) - full
        return place

    def _write(self, run: np.ndarray, used: int) -> None:
        mask = np.arange(len(run)) < used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (run, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            run = np.concatenate(self.held)
            padded = np.full(-(-len(run) // self.length) * self.length, self.end_id, self.dtype)
            padded[: len(run)] = run
            self._write(padded, len(run))
        self.out.close()


class Reader:
    """Random access to the ids of a file; sequences and masks come without copying."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        local = type(system).__name__ == "LocalFileSystem"
        self.file = pa.ipc.open_file(pa.memory_map(inner) if local else system.open_input_file(inner))
        self.length = self.file.schema.field("ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}

    def _batch(self, n: int) -> pa.RecordBatch:
        if n not in self.batches:
            self.batches = {n: self.file.get_batch(n)}
        return self.batches[n]

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence n, a view into the file, and its mask."""
        b, row = self._batch(n // ROWS), n % ROWS
        cut = slice(row * self.length, (row + 1) * self.length)
        return b.column("ids").flatten().to_numpy()[cut], b.column("mask").flatten().to_numpy(zero_copy_only=False)[cut]

    def ids(self, place: int, n: int) -> np.ndarray:
        """The n ids from a place on."""
        step, parts = self.length * ROWS, []
        while n:
            values = self._batch(place // step).column("ids").flatten().to_numpy()
            part = values[place % step : place % step + n]
            parts.append(part)
            place, n = place + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


class IndexWriter:
    """Writes the index rows of a file of ids beside it, under the same name."""

    def __init__(self, system, path: str):
        from pyarrow import parquet

        self.system, self.path = system, path
        at, _, name = path.rpartition("/")
        system.create_dir(at, recursive=True)
        self.begun = f"{at}/_{name}"  # Spark's readers pass over such names
        self.out, self.held, self.size = parquet.ParquetWriter(self.begun, FIELDS, filesystem=system), [], 0

    def add(self, *columns) -> None:
        self.held.append(pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS))
        self.size += self.held[-1].num_rows
        if self.size >= INDEX_ROWS:
            self._flush()

    def _flush(self) -> None:
        self.out.write_table(pa.concat_tables(self.held).combine_chunks())
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        self.out.close()
        self.system.move(self.begun, self.path)


def write(docs: DataFrame, vocab: tuple, folder: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Writes the files and returns the stored index: file, path, doc_id, place in the file, n_tokens. The tasks write the index too, so
    an executor starts no process for each of them to set the rights of a file; the driver gets one name a file."""
    spark = docs.sparkSession
    rows = texts_of(docs).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        codec, task = codec_of(vocab), TaskContext.get()
        n, writer = task.partitionId(), None
        name = f"ids-{n:06d}-{task.taskAttemptId()}"
        path = f"{folder}/{name}.arrow"
        system, inner = file_system(path)
        for whole in batches:
            for b in slices(whole, "text"):
                if writer is None:
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(f"{inner}.writing")
                    writer = Writer(sink, length, end_id, len(codec.token_bytes) > 1 << 16)
                    index = IndexWriter(system, f"{inner.rpartition('/')[0]}/index/{name}.parquet")
                ids, at = codec.encode_column(b.column("text"))
                place = writer.add(np.insert(ids, at[1:], end_id))
                at += np.arange(len(at))  # with an end id after each text
                index.add(np.full(b.num_rows, n), [path] * b.num_rows, b.column("doc_id"), place + at[:-1], np.diff(at))
        if writer:
            writer.close()
            sink.close()
            system.move(f"{inner}.writing", inner)
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    whole = mapped(rows, run, "path string", state=True).toArrow()
    if not whole.num_rows:
        return spark.createDataFrame([], INDEX)
    found = spark.read.schema(INDEX).parquet(f"{folder}/index")
    return found.join(F.broadcast(spark.createDataFrame(whole)), "path", "left_semi").select(*FIELDS.names)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds `start`, the number of ids before a document over all files; only one row a file is summed up in order."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return index.join(F.broadcast(firsts), "file").withColumn("start", F.col("_first") + F.col("place")).drop("_first")


def read(index: DataFrame) -> DataFrame:
    """Per document of the index its ids as read from the files (binary, little-endian unsigned 32-bit integers)."""

    def run(batches):
        reader, opened = None, ""
        for whole in batches:
            shares = np.cumsum(whole.column("n_tokens").to_numpy()) // READ_IDS
            cuts = (np.flatnonzero(np.diff(shares)) + 1).tolist()
            for b in (whole.slice(a, z - a) for a, z in pairwise([0, *cuts, whole.num_rows])):
                out = []
                for path, place, n in zip(*(b.column(c).to_pylist() for c in ("path", "place", "n_tokens")), strict=True):
                    if path != opened:
                        reader, opened = Reader(path), path
                    out.append(reader.ids(place, n).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return mapped(index.select("path", "doc_id", "place", "n_tokens", "start"), run, "doc_id long, start long, n_tokens long, ids binary", state=True)


def op8(docs: DataFrame, vocab: tuple, length: int = 2048) -> DataFrame:
    """Per document, from the written files: start, n_tokens and the crc32 of its ids."""
    folder = shared_path(docs.sparkSession, "token-files")
    index = write(docs, vocab, folder, length)
    return read(with_starts(index)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op8(load(spark, sf_dir, "documents"), vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json")))
