"""Registered queries: scalar expressions, audits, structured features, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.functions import matching as m
from hazardloom.functions import text as tx
from hazardloom.functions.ordered import with_row_number
from hazardloom.operators import audit, evaluation, extraction, modelling, structured, tagging, training, triage
from hazardloom.operators import rules
from hazardloom.plans import evaluation_queries
from hazardloom.plans import tables as tb
from hazardloom.plans import training_queries as tq
from hazardloom.session import shared_path
from hazardloom.streaming import streams


def _docs(spark, sf):
    return tb.dealt(tb.load(spark, sf, "documents"), "doc_id")


def norm_text(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.norm(F.col("text")).alias("norm"))


def norm_for_matching(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.norm_for_matching(F.col("text")).alias("match_key"), tx.norm_key(F.col("source")).alias("source_key"))


def clean_fields(spark, sf):
    note = F.when(F.col("event_type") == "click", F.lit("  ")).when(F.col("event_type") == "view", None).otherwise(F.concat(F.lit(" "), "props"))
    return tb.load(spark, sf, "events").select("event_id", tx.clean(note).alias("cleaned"), tx.clean_or_empty(note).alias("safe"))


def split_list(spark, sf):
    items = F.concat(F.col("risk"), F.lit("; ;"), F.col("site"), F.lit(" ;"), F.col("department"))
    return tb.reports(spark, sf).select("report_id", F.array_join(tx.split_list(items), "|").alias("items"), F.size(tx.split_list(items)).alias("n"))


def explode_tokens(spark, sf):
    return tb.stored_predictions(spark, sf).select("report_id", F.explode(tx.tokens(F.col("hazards"))).alias("token"))


def report_id_roundtrip(spark, sf):
    return tb.reports(spark, sf).select("report_id", tx.normalise_id(F.concat("doc_id", F.lit(".0"))).alias("a"), tx.normalise_id(F.col("report_id")).alias("b"))


def lenient_timestamp(spark, sf):
    return tb.reports(spark, sf).select("report_id", tx.lenient_timestamp(F.col("raw_date")).alias("stamp"))


def coalesce_activity(spark, sf):
    own = F.when(F.col("risk") == "Others", F.lit(" ")).otherwise(F.col("risk"))
    return tb.reports(spark, sf).select("report_id", tx.first_non_blank(own, F.col("site")).alias("activity"))


def join_unique(spark, sf):
    items = F.array(F.col("risk"), F.lower("risk"), F.col("site"), F.lit(" "), F.upper("site"), F.col("department"))
    return tb.reports(spark, sf).select("report_id", tx.join_unique(items).alias("joined"))


def sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.sentences(tx.squeeze(F.col("text")))).alias("position", "sentence"))


def sentence_offsets(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(m.sentence_offsets(F.coalesce("text", F.lit("")))).alias("s"))
    return rows.select("doc_id", "s.start", "s.stop", "s.sentence")


def token_sets(spark, sf):
    text = F.translate("text", tb.ACCENTED, tb.PLAIN)
    return _docs(spark, sf).select("doc_id", F.size(tx.token_set(text)).alias("tokens"), F.array_join(F.array_sort(tx.first_token_set(text)), " ").alias("first_tokens"))


def token_overlap(spark, sf):
    """Tokens of the metadata fields against those of the whole narrative."""
    rows = tb.reports(spark, sf)
    a = tx.token_set(F.translate(F.concat_ws(" ", "risk", "site", "department", "location"), "_", " "))
    b = tx.token_set(F.col("description"))
    sets = rows.select("report_id", m.staged(a).alias("a"), m.staged(b).alias("b"))
    return sets.select("report_id", F.round(tx.token_recall(F.col("a"), F.col("b")), 9).alias("recall"), F.round(tx.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


def text_lengths(spark, sf):
    return tb.reports(spark, sf).select("report_id", F.length("description").alias("chars"), tx.word_count(F.col("description")).alias("words"))


HEIGHT = r"(\d+(?:[.,]\d+)?)\s*(?:m|meter|meters)\b"
CUE = r"\b(?:height|voltage|distance)\b"


def max_measure(spark, sf):
    return tb.reports(spark, sf).select("report_id", tx.max_number(tx.norm(F.col("description")), HEIGHT).alias("metres"))


def number_near_cue(spark, sf):
    rows = tb.reports(spark, sf).select("report_id", m.staged(tx.norm(F.col("description"))).alias("t"))
    return rows.select("report_id", m.max_number_near(F.col("t"), CUE).alias("number"))


def context_snippet(spark, sf):
    rows = tb.reports(spark, sf).select("report_id", m.staged(tx.squeeze(F.col("description"))).alias("t"))
    return rows.select("report_id", tx.context_snippet(F.col("t"), [r"ladder", r"height", r"guard"], 40).alias("snippet"))


def fabricate_ids(spark, sf):
    rows = with_row_number(_docs(spark, sf).select("doc_id", "source"), [F.col("source"), F.col("doc_id")], "n")
    return rows.select("doc_id", tx.padded_id("input_", F.col("n")).alias("report_id"))


def _notes(spark, sf):
    """Human notes: the composed setting and outcome sentences, blank where they name nothing."""
    key = F.col("doc_id")
    setting, outcome = tb.pick(tb.SETTINGS, tb.hash_of("a", key) % 24), tb.pick(tb.OUTCOMES, tb.hash_of("b", key) % 16)
    a, b = tb.hash_of("a", key) % 24, tb.hash_of("b", key) % 16
    return tb.reports(spark, sf).select(
        "report_id", setting.alias("hazards_notes"), F.when(a < 10, setting).otherwise("").alias("exposures_notes"),
        F.when(b.between(1, 3), outcome).otherwise("").alias("consequences_notes"), F.when(b.between(5, 10), outcome).alias("barriers_notes"),
    )


def _audit(spark, sf):
    return audit.audit_rows(_notes(spark, sf), extraction.extract_v04(tb.reports(spark, sf).select("report_id", "description")))


def audit_hints(spark, sf):
    return _audit(spark, sf).select("report_id", "family", "token_recall", "audit_hint", "recall_hint", "count_hint")


def extraction_audit(spark, sf):
    return audit.audit_summary(_audit(spark, sf))


def extraction_misses(spark, sf):
    return audit.misses(_audit(spark, sf))


def features_v01(spark, sf):
    rows = tb.reports(spark, sf).select("report_id", "description", F.col("description").alias("narrative"))
    return structured.structured_features(extraction.extract_v06(rows), "narrative")


def attach_embeddings(spark, sf):
    rows = modelling.attach_embeddings(_docs(spark, sf).select("doc_id"), tb.load(spark, sf, "embeddings"), "doc_id", "vec_id")
    return rows.select("doc_id", F.size("embedding").alias("width"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


EMBEDDING_WIDTH = 64


def _assembled(spark, sf):
    rows = tb.with_labels(tb.reports(spark, sf).select("doc_id", "report_id", "description", "p"), spark, sf)
    features = tagging.pathway_feature_columns(rows)
    vectors = tb.load(spark, sf, "embeddings").select("vec_id", "embedding")
    joined = modelling.attach_embeddings(features, vectors, "doc_id", "vec_id")
    return modelling.assemble(joined, "embedding", tagging.pathway_feature_names(), EMBEDDING_WIDTH)


def assembled_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    return _assembled(spark, sf).select("report_id", F.size(vector_to_array("features")).alias("width"))


def _train(df):
    return df.where(F.col("label").isNotNull()).withColumn("truth", (F.col("label") == "YES").cast("double"))


TERMS = 10_000


def _term_vectors(spark, sf, plain):
    docs = tb.dealt(tb.load(spark, sf, "documents").select("doc_id", "text"), "doc_id", tb.TERM_TASK_BYTES)
    counts = modelling.term_counts(docs, "doc_id", "text", tb.ACCENTED, tb.PLAIN)
    weights = modelling.term_weights(counts, modelling.vocabulary(counts, tb.load(spark, sf, "documents").count(), TERMS), "doc_id")
    return modelling.sparse_vectors(weights, "doc_id", TERMS, plain=plain)


def _hybrid(spark, sf):
    """Per report its term weights as a sparse vector with the embedding and its flag, and the label."""
    from pyspark.ml.feature import VectorAssembler

    rows = tb.with_labels(tb.reports(spark, sf).select("doc_id", "report_id"), spark, sf).join(_term_vectors(spark, sf, False), "doc_id", "left")
    joined = modelling.attach_embeddings(rows, tb.load(spark, sf, "embeddings").select("vec_id", "embedding"), "doc_id", "vec_id")
    filled = joined.join(F.broadcast(modelling.empty_vector(spark, TERMS))).withColumn("sparse", F.coalesce("sparse", "none"))  # one row
    dense = modelling.assemble(filled, "embedding", [], EMBEDDING_WIDTH)
    whole = VectorAssembler(inputCols=["sparse", "features"], outputCol="all").transform(dense)
    return whole.select("report_id", "label", F.col("all").alias("features"))


def hybrid_vectors(spark, sf):
    """Per report the width of its hybrid vector, and the non-zero entries and squared length of its term part as stored."""
    terms = _term_vectors(spark, sf, True).select("doc_id", F.col("sparse.size").alias("size"), F.size(F.filter("sparse.values", lambda x: x != 0)).alias("entries"), F.aggregate("sparse.values", F.lit(0.0), lambda a, x: a + x * x).alias("length"))
    rows = tb.reports(spark, sf).select("doc_id", "report_id").join(terms, "doc_id", "left")
    return rows.select(
        "report_id", (F.coalesce("size", F.lit(TERMS)) + EMBEDDING_WIDTH + 1).alias("width"), F.coalesce("entries", F.lit(0)).alias("entries"),
        F.round(F.coalesce("length", F.lit(0.0)), 6).alias("squared_length"),
    )


def hybrid_scores(spark, sf):
    """Term weights beside the embedding, balanced logistic regression; the steps are bounded, as each is a pass over the rows."""
    rows = training.stored(_hybrid(spark, sf), "hybrid-rows")
    return modelling.score(modelling.logistic(_train(rows), "truth", 0.25, steps=100), rows).select("report_id", F.round("score", 6).alias("score"))


def _structured(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    rows = tb.with_labels(tagging.pathway_feature_columns(tb.reports(spark, sf).select("report_id", "description")).drop("description"), spark, sf)
    return training.stored(VectorAssembler(inputCols=tagging.pathway_feature_names(), outputCol="features").transform(rows).select("report_id", "label", "features"), "structured-rows")


def structured_models(spark, sf):
    """Scores of four logistic variants and a random forest on the pathway features."""
    rows = _structured(spark, sf)
    train = _train(rows)
    models = {f"logistic_{k}": modelling.logistic(train, "truth", c, l1) for k, (c, l1) in {"l2_01": (0.1, 0.0), "l2_1": (1.0, 0.0), "l1_05": (0.5, 1.0), "l1_1": (1.0, 1.0)}.items()}
    models["forest"] = modelling.forest(train, "truth")
    parts = [modelling.score(model, rows).select("report_id", F.lit(k).alias("model"), F.round("score", 6).alias("score")) for k, model in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_coefficients(spark, sf):
    model = modelling.logistic(_train(_structured(spark, sf)), "truth", 0.5)
    return modelling.top_coefficients(modelling.coefficient_table(model, tb.load(spark, sf, "labels"), tagging.pathway_feature_names()), 10)


# The candidates of the inverse penalty.
C_GRID = [0.1, 0.25, 0.5, 1.0]


def c_grid_scores(spark, sf):
    """Validation rows scored by the model of each C, fitted on the training split; the grid is one job. Stored once for the metrics."""
    rows = tq.model_rows(spark, sf).drop("truth").join(evaluation_queries.group_safe_split(spark, sf).select("report_id", "truth", "split"), "report_id")
    side = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1)
    rows = training.stored(rows.where(side.isNotNull()).withColumn("folds", F.array(side)), "split-features")
    layout = training.layout_of(rows, tq.FEATURES, tq.VECTOR)
    scores = training.cross_validated(rows, layout, [training.Spec("grid", 0, 1, c) for c in C_GRID], 2)
    return training.stored(scores.select("c", "report_id", F.col("truth").cast("int").alias("truth"), F.round("score", 9).alias("score")), "grid-scores")


def c_grid_coverage(spark, sf):
    """Every validation row is scored once for each C."""
    missing = F.count_if(F.col("score").isNull())
    return c_grid_scores(spark, sf).groupBy("c").agg(F.count("report_id").alias("scored"), F.sum("truth").alias("positives"), missing.alias("without_score"))


def select_best_c(spark, sf):
    """The C whose model does best on the validation split, by F2, recall, average precision, precision and the smaller C."""
    return evaluation.select_best_c(evaluation.grid_metrics(c_grid_scores(spark, sf), C_GRID))


def batch_inference(spark, sf):
    """Score, tag, prioritise and order every report; one without a vector is scored by its other features."""
    scored = tq.logreg_scores(spark, sf)
    tagged = tagging.evidence_v15_tags(tb.reports(spark, sf).drop("p")).join(scored.withColumnRenamed("score", "p"), "report_id")
    out = triage.priority_v12(tagged)
    return out.select("report_id", "p", (F.col("p") >= 0.5).cast("int").alias("prediction_at_0_50"), "review_priority", "model_evidence_conflicts", "hazards", "pathways").orderBy(
        triage.priority_rank(F.col("review_priority")), F.desc("p"), "report_id"
    )


def stream_triage(spark, sf):
    source = tb.narrate(streams.file_stream(spark, sf, "documents"))
    out = streams.append_available(
        streams.triage_stream(source).select("report_id", "p", "review_priority", "review_priority_reason", rules.render_candidates(F.col("rule_candidates")).alias("rules")),
        shared_path(spark, "triage"), shared_path(spark, "triage-log"),
    )
    return out


def _review_stream(spark, sf):
    count = tb.load(spark, sf, "documents").count()
    return tb.review_rows(streams.file_stream(spark, sf, "events"), F.lit(count))


def stream_reviews(spark, sf):
    known = tb.reports(spark, sf).select("report_id")
    return streams.append_available(streams.valid_review_stream(_review_stream(spark, sf), known), shared_path(spark, "reviews"), shared_path(spark, "reviews-log"))


def stream_latest_review(spark, sf):
    latest = streams.latest_stream(_review_stream(spark, sf))
    return streams.upsert_available(latest, shared_path(spark, "latest"), shared_path(spark, "latest-log"), "report_id", "id")


def stream_decision_counts(spark, sf):
    return streams.decision_counts(stream_latest_review(spark, sf))


def report_ids_large(spark, sf):
    """Ids beyond six digits, made and read back."""
    made = tb.report_id_of(F.col("doc_id") + 10_000_000)
    return tb.load(spark, sf, "documents").select("doc_id", made.alias("report_id"), tx.normalise_id(made).alias("number"))


QUERIES = {
    "norm_text": norm_text, "norm_for_matching": norm_for_matching, "clean_fields": clean_fields, "split_list": split_list,
    "explode_tokens": explode_tokens, "report_id_roundtrip": report_id_roundtrip, "lenient_timestamp": lenient_timestamp,
    "coalesce_activity": coalesce_activity, "join_unique": join_unique, "sentences": sentences,
    "sentence_offsets": sentence_offsets, "token_sets": token_sets, "token_overlap": token_overlap,
    "text_lengths": text_lengths, "max_measure": max_measure, "number_near_cue": number_near_cue,
    "context_snippet": context_snippet, "fabricate_ids": fabricate_ids, "audit_hints": audit_hints,
    "extraction_audit": extraction_audit, "extraction_misses": extraction_misses, "features_v01": features_v01,
    "attach_embeddings": attach_embeddings, "assembled_features": assembled_features,
    "hybrid_scores": hybrid_scores, "hybrid_vectors": hybrid_vectors, "structured_models": structured_models, "top_coefficients": top_coefficients,
    "batch_inference": batch_inference, "c_grid_scores": c_grid_scores, "c_grid_coverage": c_grid_coverage, "select_best_c": select_best_c, "stream_triage": stream_triage, "stream_reviews": stream_reviews,
    "stream_latest_review": stream_latest_review, "stream_decision_counts": stream_decision_counts, "report_ids_large": report_ids_large,
}
