"""Registered queries: fitted packages and cross-validation over the narrative features and the embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.operators import evaluation as ev
from hazardloom.operators import spans, training
from hazardloom.plans import evaluation_queries as eq
from hazardloom.plans import tables as tb
from hazardloom.session import shared_path

FEATURES = spans.precursor_feature_names()
VECTOR = "embedding"
PACKAGE_C = 0.1
#: Column sets that are compared; the first is the base of the differences.
SETS = {"embedding": ((), True), "structured": (tuple(FEATURES), False), "combined": (tuple(FEATURES), True)}
CV_C = 0.25


def model_rows(spark, sf) -> DataFrame:
    """Per report: label, truth (null without a label), all narrative features and the embedding; stored once."""

    def build() -> DataFrame:
        vectors = tb.load(spark, sf, "embeddings").select(tb.report_id_of(F.col("vec_id")).alias("report_id"), VECTOR)
        rows = tb.with_labels(eq.features_v02(spark, sf), spark, sf).join(vectors, "report_id", "left")
        return rows.withColumn("truth", (F.col("label") == "YES").cast("int"))

    return tb.stored_once(spark, sf, "model-rows", ["documents", "labels", "embeddings"], build)


def _split_rows(spark, sf) -> DataFrame:
    return model_rows(spark, sf).join(eq.group_safe_split(spark, sf).select("report_id", "split"), "report_id")


def _package(spark, sf) -> training.Package:
    """Fitted on the training split."""
    return training.fit_package(_split_rows(spark, sf).where("split = 'train'"), FEATURES, VECTOR, PACKAGE_C, name="reports")


def model_package(spark, sf) -> DataFrame:
    """The manifest of a saved and reloaded package: what was kept, and the fitted medians, means and deviations of the columns."""
    folder = shared_path(spark, "package")
    _package(spark, sf).save(spark, folder)
    package = training.Package.load(spark, folder)
    rows = [(f["name"], f["kept"], f["values"], f["median"], round(f["mean"], 6), round(f["deviation"], 6), f["name"] in package.nullable) for f in package.features if f["name"] in package.columns]
    return spark.createDataFrame(rows, "feature string, kept boolean, n_values long, median double, mean double, deviation double, has_flag boolean")


def package_roundtrip(spark, sf) -> DataFrame:
    """Per split the rows scored by a package and by its reloaded copy, the largest difference, and the broken tables it refused."""
    folder = shared_path(spark, "package")
    package = _package(spark, sf)
    package.save(spark, folder)
    again = training.Package.load(spark, folder)
    rows = _split_rows(spark, sf)
    broken = [rows.drop(FEATURES[0]), rows.withColumn(FEATURES[1], F.col(FEATURES[1]).cast("string")), rows.drop(VECTOR)]
    scored = again.score(package.score(rows, "first"), "second")
    inside = F.count_if(F.col("first").between(0, 1) & F.col("second").between(0, 1))
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), inside.alias("scored"), F.max(F.abs(F.col("first") - F.col("second"))).alias("largest_difference"),
        F.lit(sum(bool(again.broken(b)) for b in broken)).alias("refused"),
    )


def logreg_scores(spark, sf) -> DataFrame:
    """Every report scored by the package fitted on all labelled ones; one without a vector is scored by its other features."""
    rows = model_rows(spark, sf)
    return training.fit_package(rows, FEATURES, VECTOR, PACKAGE_C).score(rows).select("report_id", F.round("score", 6).alias("score"))


def _folded(spark, sf) -> DataFrame:
    """Labelled rows with their group and their fold in each repeat."""
    dealt = eq.group_folds(spark, sf).groupBy("report_id", "duplicate_group_id").agg(F.sort_array(F.collect_list(F.struct("repeat", "fold"))).alias("x"))
    folds = dealt.select("report_id", "duplicate_group_id", F.col("x.fold").alias("folds"))  # one entry a repeat
    return training.stored(training.evenly(model_rows(spark, sf).where("truth is not null").join(folds, "report_id"), "report_id"), "folded-rows")


def cv_scores(spark, sf) -> DataFrame:
    """Out-of-fold scores of every column set in every repeat: all models are fitted in one job. Stored once."""

    def build() -> DataFrame:
        rows = _folded(spark, sf)
        layout = training.layout_of(rows, FEATURES, VECTOR)
        specs = [training.Spec(name, r, f, CV_C, columns, vector) for name, (columns, vector) in SETS.items() for r in range(eq.REPEATS) for f in range(eq.FOLDS)]
        return training.cross_validated(rows, layout, specs, eq.FOLDS)

    return tb.stored_once(spark, sf, "cv-scores", ["documents", "labels", "embeddings"], build)


def cv_metrics(spark, sf) -> DataFrame:
    return ev.binary_metrics(cv_scores(spark, sf), "score", "truth", 0.5, ["model", "repeat", "fold"])


def cv_coverage(spark, sf) -> DataFrame:
    """Per model, repeat and fold: rows scored and their positives, whether each was scored once, with a score, and whether a group
    of the fold is also in the part that its model was trained on."""
    scores = cv_scores(spark, sf)
    counts = scores.groupBy("model", "repeat", "fold").agg(
        F.count(F.lit(1)).alias("records"), F.sum("truth").alias("positives"), (F.count("report_id") == F.countDistinct("report_id")).alias("once"),
        (F.count_if(F.col("score").between(0, 1)) == F.count(F.lit(1))).alias("all_scored"),
    )
    split = eq.group_folds(spark, sf).groupBy("repeat", "duplicate_group_id").agg(F.min("fold").alias("least"), F.max("fold").alias("most"))
    leaks = split.groupBy("repeat").agg(F.count_if(F.col("least") != F.col("most")).alias("groups_in_two_folds"))
    return counts.join(leaks, "repeat")


def cv_oof_coverage(spark, sf) -> DataFrame:
    """Reports by the number of repeats their mean out-of-fold score comes from."""
    out = ev.oof_scores(cv_scores(spark, sf).where("model = 'combined'"), eq.REPEATS)
    return out.groupBy("parts", "complete").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("oof_score").between(0, 1)).alias("scored"))


def cv_summary(spark, sf) -> DataFrame:
    """Mean, deviation, minimum and maximum of every metric over the folds, and the difference of the mean to the base model's."""
    summary = ev.fold_summary(cv_metrics(spark, sf), eq.METRICS, ["model"])
    return summary.join(ev.model_deltas(summary, next(iter(SETS))).select("model", "metric", "delta"), ["model", "metric"])


QUERIES = {
    "logreg_scores": logreg_scores, "model_package": model_package, "package_roundtrip": package_roundtrip, "cv_scores": cv_scores,
    "cv_coverage": cv_coverage, "cv_oof_coverage": cv_oof_coverage, "cv_summary": cv_summary,
}
