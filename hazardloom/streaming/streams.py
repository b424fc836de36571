"""Structured Streaming jobs: report triage, review ingest, latest decision per report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.operators import preparation, rules, tagging, triage


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet files of one table as they arrive: the table is a file, or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    # written as a pattern, the path may be that of a file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def triage_stream(reports: DataFrame) -> DataFrame:
    """Stateless enrichment: evidence, priority and rule candidates of arriving narratives."""
    return rules.rule_candidates(triage.priority_v14(tagging.evidence_v15_tags(reports)))


def valid_review_stream(reviews: DataFrame, reports: DataFrame) -> DataFrame:
    """Arriving reviews of known reports (stream-static semi join)."""
    return preparation.valid_reviews(reviews, reports)


def latest_stream(reviews: DataFrame) -> DataFrame:
    """Newest decision per report by review id, whatever the order of arrival."""
    return reviews.groupBy("report_id").agg(F.max("id").alias("id"), F.max_by("decision", "id").alias("decision"))


def append_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run what is there into an append-only Parquet table and read it back; nothing arrived gives an empty table."""
    spark = stream.sparkSession
    # without a finished batch the folder holds this file alone; the sink's log hides it from the first batch on
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


EVENTS = "kind string, number long, folder string"
COMPACT_AFTER = 8  # deltas


class NewestTable:
    """The newest row per key as a log: batches add files of their own rows, and nothing written is ever changed.

    `events` is a small table with a row for each published file set: a delta of batch `number`, or a base that holds all batches up to
    `number`. A row appears by the commit of one file, so a reader sees a version before it or after it, never half. What a killed
    batch has written without an event is not read; when it runs again it writes anew, and a batch with an event is not written
    twice. Compaction makes a base of the newest base and the deltas after it; it can run beside batches and readers, as it only adds
    files and an event. Files that no version uses are left to the folder's clean-up."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.log = f"{self.path}/events"
        spark.createDataFrame([], EVENTS).write.mode("ignore").parquet(self.log)

    def live(self) -> tuple[str | None, list[str], int]:
        """Folder of the newest base, those of the deltas after it, and the last batch published."""
        events = self.spark.read.schema(EVENTS).parquet(self.log)
        base = events.where("kind = 'base'").agg(F.max(F.struct("number", "folder")).alias("b")).first().b
        after = base.number if base else -1
        # of a batch that was published twice one delta is enough: both have the same rows
        deltas = events.where((F.col("kind") == "delta") & (F.col("number") > after)).groupBy("number").agg(F.min("folder").alias("folder")).collect()
        return base.folder if base else None, [d.folder for d in deltas], max([after, *[d.number for d in deltas]])

    def publish(self, kind: str, number: int, folder: str) -> None:
        self.spark.createDataFrame([(kind, number, folder)], EVENTS).coalesce(1).write.mode("append").parquet(self.log)

    def add(self, batch: DataFrame, number: int) -> None:
        """A batch of rows; several of a key are allowed."""
        if number <= self.live()[2]:
            return
        folder = f"{self.path}/delta-{number:09d}-{uuid.uuid4().hex}"
        batch.write.parquet(folder)
        self.publish("delta", number, folder)

    def newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.schema.names if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), self.order).alias("x")).select(self.key, *[F.col(f"x.{c}").alias(c) for c in others]).select(*self.schema.names)

    def read(self) -> DataFrame:
        """The table as of now. A base has one row a key, so without deltas nothing is shuffled."""
        base, deltas, _ = self.live()
        folders = [*([base] if base else []), *deltas]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        return self.newest(rows) if deltas else rows

    def compact(self, least: int = 1) -> bool:
        """Publishes a base of all that is there, if so many deltas have come since the last."""
        base, deltas, last = self.live()
        if len(deltas) < least:
            return False
        folder = f"{self.path}/base-{last:09d}-{uuid.uuid4().hex}"
        self.newest(self.spark.read.schema(self.schema).parquet(*([base] if base else []), *deltas)).write.parquet(folder)
        self.publish("base", last, folder)
        return True


def upsert_available(stream: DataFrame, path: str, checkpoint: str, key: str, order: str) -> DataFrame:
    """Keep the newest row per key of what has arrived: a batch writes its own rows only. Deltas are merged after the batches."""
    table = NewestTable(stream.sparkSession, path, stream.schema, key, order)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table.add).start()
    query.awaitTermination()
    table.compact(COMPACT_AFTER)
    return table.read()


def decision_counts(latest: DataFrame) -> DataFrame:
    """Reports by their latest decision, from the table that the upsert keeps current."""
    return latest.groupBy("decision").agg(F.count(F.lit(1)).alias("reports"))
