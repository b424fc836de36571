"""Dealing of a table without the session setting."""

from pyspark.sql import functions as F

from hazardloom.plans import tables as tb


def test_a_table_of_one_split_is_dealt_out_without_the_setting(spark, tmp_path, monkeypatch):
    spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(tb.INPUT_PARTITIONS)
    spark.conf.unset(tb.INPUT_PARTITIONS)
    try:
        docs = tb.load(spark, str(tmp_path), "documents")
        assert tb.dealt(docs, "doc_id").select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
        monkeypatch.setattr(tb, "TASK_BYTES", 20_000)
        dealt = tb.dealt(docs, "doc_id")
        assert dealt.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism
        assert dealt.count() == 4000
    finally:
        spark.conf.set(tb.INPUT_PARTITIONS, before)
