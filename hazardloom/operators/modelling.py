"""Model preparation and fitting with Spark ML on scalable statistics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hazardloom.functions.matching import staged
from hazardloom.functions.ordered import exact_quantiles
from hazardloom.session import shared_path


def impute_with_indicator(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median (zero without values); a 0/1 column marks them."""
    out = df
    for c in columns:
        median = exact_quantiles(df.select(c), [], c, {"m": 0.5}).select("m").scalar()
        out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("int")).withColumn(c, F.coalesce(F.col(c), median, F.lit(0.0)))
    return out


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes zero."""
    out = df
    for c in columns:
        mean, spread = df.agg(F.avg(c)).scalar(), df.agg(F.stddev_pop(c)).scalar()
        out = out.withColumn(c, F.round(F.when(spread == 0, F.lit(0.0)).otherwise((F.col(c) - mean) / spread), 6))
    return out


def term_counts(df: DataFrame, id_column: str, text: str, accents: str, plain: str) -> DataFrame:
    """(id, term, tf) of words and word pairs. Rows dealt by id stay where they are: neither these counts nor a row's weights are
    shuffled, and the vocabulary and the weights share the exchange that dealt the texts."""
    folded = F.translate(F.lower(F.col(text)), accents.lower(), plain.lower())
    words = F.regexp_extract_all(folded, F.lit(r"\b\w\w+\b"), 0)
    rows = df.select(F.col(id_column), staged(words).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))
    return rows.select(id_column, staged(grams).alias("g")).select(id_column, F.explode("g").alias("term")).groupBy(id_column, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n: int, features: int, max_share: float = 0.98) -> DataFrame:
    """(term, idf, position) of the most frequent terms, those in nearly all rows left out; positions follow the order of frequency."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = terms.where(F.col("df") <= max_share * n).orderBy(F.desc("total"), "term").limit(features)
    idf = F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1
    # at most `features` rows
    return kept.select("term", idf.alias("idf"), (F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1).alias("position"))


def term_weights(counts: DataFrame, terms: DataFrame, id_column: str) -> DataFrame:
    """(id, term, position, weight): sublinear term frequency, smooth idf, unit rows."""
    raw = (F.log(F.col("tf").cast("double")) + 1) * F.col("idf")
    weighted = counts.join(F.broadcast(terms), "term").withColumn("raw", raw)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_column)))
    return weighted.select(id_column, "term", "position", (F.col("raw") / norm).alias("weight"))


def tfidf(df: DataFrame, id_column: str, text: str, accents: str, plain: str, features: int, max_share: float = 0.98) -> DataFrame:
    """Word and word-pair weights over the most frequent terms."""
    counts = term_counts(df, id_column, text, accents, plain)
    weights = term_weights(counts, vocabulary(counts, df.count(), features, max_share), id_column)
    return weights.select(id_column, "term", F.round("weight", 6).alias("weight"))


def sparse_vectors(weights: DataFrame, id_column: str, width: int, name: str = "sparse", plain: bool = False) -> DataFrame:
    """(id, vector) from weights at positions, stored. A vector is written as the struct that its type is kept as, and read back
    under that type, so no row passes through Python; with `plain` it is read back as the struct."""
    entries = F.sort_array(F.collect_list(F.struct("position", "weight")))  # at most `width` for a row
    rows = weights.groupBy(id_column).agg(entries.alias("x"))
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"),
        F.col("x.position").cast("array<int>").alias("indices"), F.col("x.weight").cast("array<double>").alias("values"),
    )
    path = shared_path(weights.sparkSession, "sparse-vectors")
    rows.select(id_column, parts.alias(name)).write.parquet(path)
    if plain:
        return weights.sparkSession.read.parquet(path)
    schema = StructType([weights.schema[id_column], StructField(name, VectorUDT())])
    return weights.sparkSession.read.schema(schema).parquet(path)


def empty_vector(spark, width: int, name: str = "none") -> DataFrame:
    """One row with a vector of zeros."""
    return spark.createDataFrame([(Vectors.sparse(width, [], []),)], StructType([StructField(name, VectorUDT())]))


def attach_embeddings(df: DataFrame, vectors: DataFrame, id_column: str, vector_id: str, column: str = "embedding") -> DataFrame:
    """Precomputed vectors joined by id, never by position; rows without one keep a null vector."""
    return df.join(vectors.select(F.col(vector_id).alias(id_column), column), id_column, "left")


def assemble(df: DataFrame, vector: str, columns: list[str], width: int) -> DataFrame:
    """Vector, a flag for rows without one (whose vector is zeros), and feature columns; rows whose
    embedding has another width fail loudly."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    df = df.withColumn(f"{vector}_missing", F.col(vector).isNull().cast("int"))
    checked = F.when(F.col(vector).isNull(), zeros).when(F.size(vector) == width, F.col(vector)).otherwise(F.raise_error(F.lit(f"embedding width is not {width}")))
    with_vector = df.withColumn("_v", array_to_vector(checked))
    return VectorAssembler(inputCols=["_v", f"{vector}_missing", *columns], outputCol="features").transform(with_vector).drop("_v")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (2 n_class)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    ones = df.agg(F.sum(F.col(label).cast("bigint"))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))))


def logistic(train: DataFrame, label: str, c: float, l1: float = 0.0, steps: int = 5000):
    """Balanced logistic regression with the strength of an inverse-C penalty over n rows, in so many steps at most."""
    n = train.count()
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=l1,
        standardization=False, maxIter=steps,
    ).fit(balanced(train, label))


def forest(train: DataFrame, label: str):
    return RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=300, maxDepth=4, minInstancesPerNode=2, seed=42
    ).fit(balanced(train, label))


def score(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def coefficient_table(model, df: DataFrame, names: list[str]) -> DataFrame:
    """Named coefficients of a fitted linear model, as long as its feature vector."""
    pairs = F.arrays_zip(F.lit(list(names)).alias("feature"), F.lit([float(x) for x in model.coefficients]).alias("value"))
    return df.sparkSession.range(1).select(F.explode(pairs).alias("x")).select("x.feature", "x.value")


def top_coefficients(coefficients: DataFrame, k: int) -> DataFrame:
    """Strongest positive and negative coefficients with their direction."""
    up = coefficients.orderBy(F.desc("value"), "feature").limit(k).withColumn("direction", F.lit("positive"))
    down = coefficients.orderBy("value", "feature").limit(k).withColumn("direction", F.lit("negative"))
    return up.unionByName(down)


# Outcome-like columns and name parts that must not feed a model.
FORBIDDEN = ["label", "truth", "p", "p2", "sif_potential", "final_sif_potential", "actual_level", "potential_level"]
FORBIDDEN_PARTS = ["outcome", "consequence", "severity", "label", "fatal", "injury", "precursor_score", "band"]


def feature_policy(df: DataFrame) -> DataFrame:
    """(column, allowed, reason) over the schema: exact names, name parts, non-numeric types are out."""
    rows = []
    for field in df.schema.fields:
        name = field.name.lower()
        part = next((x for x in FORBIDDEN_PARTS if x in name), None)
        numeric = field.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "boolean")
        reason = "exact" if name in FORBIDDEN else f"contains {part}" if part else "" if numeric else "type"
        rows.append((field.name, reason == "", reason))
    return df.sparkSession.createDataFrame(rows, "column string, allowed boolean, reason string")
