"""Small tables with the awkward cases every operator must take, and readers."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
SF = "/root/testdata/sf0.001"


def documents(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, langs[n] if langs else "en", "src0", None if t is None else len(t)) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """Extra columns named like those that operators work with."""
    from pyspark.sql import functions as F

    return df.selectExpr("*", "1 as bucket", "'x' as ids", "2 as n_words", "'y' as kept", "3 as label", "4 as score", "5 as file", "6 as _k1", "7 as cls").withColumn("held_out", F.lit(None).cast("string"))


AWKWARD = [None, "", " ", "\n\n", "word", "a b", "a  b\t\n c", "é", "𝔘nicode ☃    x", "x" * 70_000, "same text here", "same text here", "long " * 30_000]
