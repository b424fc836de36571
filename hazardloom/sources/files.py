"""File sources and sinks: raw CSV, canonical Parquet, CSV and JSON-lines tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hazardloom.operators.preparation import RAW_COLUMNS

RAW_SCHEMA = StructType([StructField(c, StringType()) for c in RAW_COLUMNS.values()])


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_existing(df: DataFrame, candidates: list[str], target: str) -> DataFrame:
    """Renames the first candidate column that exists, compared without case."""
    known = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in known:
            return df.withColumnRenamed(known[name.lower()], target)
    raise ValueError(f"none of {candidates} found")


QUOTE = '"'


def quote_parity(lines: DataFrame) -> DataFrame:
    """(file, start, odd): whether a quoted field is open where a split of a file begins; one row for each split."""
    counts = lines.groupBy("file", "start").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("odd"))


def _records(lines: DataFrame) -> DataFrame:
    """(file, start, place, n, text) of lines with `odd`: whole records (place 1), what ends a record of an earlier split (0), and the
    begin of one that a later split ends (2). n counts the whole records of a split."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("n", pa.int64()), ("text", pa.string())])

    def run(batches):
        key, held, n, odd = None, [], 0, False

        def row(place, text, number):
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, place, number, text), schema, strict=True)], schema=schema)

        def rest():
            # what is open at the end of a split: a begun record, or all of it where none has begun
            if key is not None and held:
                yield row(2 if begun else 0, "\n".join(held), n)

        begun = False
        for b in batches:
            for part in runs_of(b):
                own = (part.column("file")[0].as_py(), part.column("start")[0].as_py())
                if own != key:
                    yield from rest()
                    key, held, n, odd = own, [], 0, part.column("odd")[0].as_py()
                    begun = not odd
                values = part.column("value")
                quotes = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False)
                after = (np.cumsum(quotes) + odd) % 2 == 1  # a field is open after the line
                before = np.concatenate([[odd], after[:-1]])
                single = np.flatnonzero(~before & ~after)
                numbers = np.cumsum(~after & (np.cumsum(~before) + begun > 0))  # whole records so far, this one included
                if len(single):
                    size = len(single)
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * size, pa.string()), pa.array(np.full(size, key[1]), pa.int64()), pa.array(np.ones(size), pa.int32()), pa.array(n + numbers[single], pa.int64()), values.take(pa.array(single))], schema=schema)
                for i in np.flatnonzero(before | after).tolist():
                    if not before[i]:
                        held, begun = [], True
                    held.append(values[i].as_py())
                    if not after[i]:
                        yield row(1 if begun else 0, "\n".join(held), int(n + numbers[i]))
                        held, begun = [], True
                n, odd = n + (int(numbers[-1]) if len(numbers) else 0), bool(after[-1]) if len(after) else odd
        yield from rest()

    return lines.mapInArrow(run, "file string, start long, place int, n long, text string")


def runs_of(b: pa.RecordBatch):
    """The batch cut where the file or the split changes."""
    start = b.column("start").to_numpy()
    files = b.column("file").dictionary_encode().indices.to_numpy()
    edges = [0, *(1 + np.flatnonzero((start[1:] != start[:-1]) | (files[1:] != files[:-1]))).tolist(), b.num_rows]
    for a, e in zip(edges[:-1], edges[1:], strict=True):
        if e > a:
            yield b.slice(a, e - a)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of CSV files with quoted line breaks; `first` marks the header of a file.

    Files are read in splits by many tasks. The number of quotes in the splits before says whether a split begins inside a quoted field,
    so every task knows its records; only the pieces of records that cross a split, two for each split at most, are put together."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.rtrim("value", F.lit("\r")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    marked = lines.join(F.broadcast(quote_parity(lines)), ["file", "start"])  # one row for each split
    found = _records(marked.select("value", "file", "start", "odd"))
    whole = found.where("place = 1").select("file", ((F.col("start") == 0) & (F.col("n") == 1)).alias("first"), F.col("text").alias("record"))
    pieces = found.where("place <> 1")
    upto = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.withColumn("record_no", F.sum(F.when(F.col("place") == 2, 1).otherwise(0)).over(upto))
    joined = numbered.groupBy("file", "record_no").agg(F.sort_array(F.collect_list(F.struct("start", "place", "text"))).alias("x"), F.min(F.struct("start", "n")).alias("at"))
    crossing = joined.select("file", ((F.col("at.start") == 0) & (F.col("at.n") == 0)).alias("first"), F.array_join("x.text", "\n").alias("record"))
    return whole.unionByName(crossing)


def read_table_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Header CSV with quoted line breaks, all columns as text, so ids keep their zeros. A large file is read by many tasks.

    Quotes stand around fields and are doubled inside them; a file with single quotes elsewhere is not CSV of this kind. Line ends in a
    field come out as line feeds, whatever they are in the file; empty lines are left out."""
    names = schema.names if schema else spark.read.option("header", True).option("multiLine", True).option("escape", QUOTE).csv(path).columns
    shape = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = csv_records(spark, path).where(~F.col("first") & (F.trim("record") != ""))
    parsed = rows.select(F.from_csv("record", shape.simpleString()[7:-1].replace(":", " "), {"escape": QUOTE, "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("x"))
    return parsed.select(*[F.col(f"x.c{i}").alias(n) for i, n in enumerate(names)])


def read_raw_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Raw incident CSV with its required columns."""
    return require_columns(read_table_csv(spark, path), RAW_SCHEMA.names)


def write_canonical(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One aggregated row as a JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
