"""Corpus preparation in five stages, each over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` stores every stage's rows as Parquet in the shared folder
and reads them back, so a stage begins from stored data. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm import byte_bpe, decontamination, ngram_join, quality_classifier, suffix_dedup
from hazardloom.llm.common import load, staged
from hazardloom.llm.queries import small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of these documents."""
    small_batches(spark)
    return quality_classifier.filtered(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that with the smallest id."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in repeated 200-byte strings go; n_chars follows the text."""
    small_batches(spark)
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontamination.clean(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, their number, and digests of the ids and of the bytes they decode to."""
    small_batches(spark)
    vocab = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, vocab), vocab), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE encoding and decoding", tokens),
]

#: No SQL states a trained classifier; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return docs
