"""Working tables derived from the given ones: reports, reviews, predictions and their variants.

Each narrative is a composed incident sentence pair followed by the whole text of its
document with accents folded to ASCII, so patterns have hits and work grows with the corpus.
Hash columns are md5 based, so any engine can rebuild them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.functions.text import first_non_blank, label_text, norm_for_matching, padded_id, short_hash
from hazardloom.operators import extraction, rules, tagging, triage
from hazardloom.session import shared_path

# Setting, hazard and mechanism sentences.
SETTINGS = [
    "Operator touched the energized cable and received an electric shock.",
    "Mechanic was cleaning the conveyor when a hand was caught between the belt and the roller.",
    "Chemical splash reached the face of the worker during sampling at the acid tank.",
    "Steam line released hot vapour and the technician was burned on the arm.",
    "Truck reversing in the yard struck a pedestrian near the loading bay.",
    "Employee fell from the ladder while painting at a height of 3 m.",
    "Hydraulic hose under pressure failed and a metal fragment was ejected toward the operator.",
    "Falling object from the scaffold was projected and hit a worker in the walkway.",
    "Forklift driver wearing a seat belt moved a suspended load across the warehouse.",
    "Small fire started near flammable material during welding of the tank shell.",
    "Water and mud flow splashed onto the boots of the crew at the drainage channel.",
    "Inspection of the transformer confirmed the unit was de-energized and disabled.",
    "Routine housekeeping of the office area was completed.",
    "A bee sting was reported by a collaborator in the vegetation.",
    "Crane lifting a 440 V motor swung and the load remained contained inside the barricade.",
    "Ammonia leak was detected, no personnel were affected and the area was cordoned off.",
    "Worker was in the line of fire when the compressed air line was opened.",
    "Supervisor reviewed the work permit and the checklist before the excavation.",
    "Machine guard was removed and the fan was operating with the bonnet open.",
    "The technician slipped on the platform and reported no injury.",
    "Person entered the confined space without isolation of the agitator drive.",
    "Drilling rig was struck by a rock block that detached from the roof.",
    "Cutting with a knife caused a small cut on the finger of the operator.",
    "Voltage of 230 V was measured at the switchboard, distance 2.5 m from the crew.",
]

# Outcome, barrier and context sentences.
OUTCOMES = [
    "No further details were recorded.",
    "The injury was minor with slight redness.",
    "The worker was hospitalized with a fracture.",
    "The event was fatal.",
    "The worker returned to work after first aid.",
    "Gloves and helmet were used.",
    "The operator was not wearing gloves.",
    "The crew had no harness and no lifeline.",
    "The circuit was not isolated and no lockout was applied.",
    "A barricade and a spotter were in place.",
    "The guard was missing.",
    "There was loss of consciousness.",
    "The area supervisor stopped the task.",
    "The height was about 1 m above ground.",
    "Procedure and risk assessment were followed.",
    "A severe burn was observed.",
]

# Scores that sit on a policy threshold, one in ten of the rows; critical risks; accents.
EDGE_SCORES = [0.90, 0.75, 0.50, 0.30, 0.80, 0.20, 0.25, 0.8999, 0.7499, 0.4999]
RISKS = ["Cut", "Fall", "Pressed", "Projection", "Vehicles", "Chemical", "Others"]
LEVEL_NAMES = ["I", "II", "III", "IV", "V", "VI"]
ACCENTED = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍ"
PLAIN = "eoenucaoesiEENOCEUOAI"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Setting of a session: tasks to deal a table out to. Unset, one for each `TASK_BYTES` of its files, and one a core at least.
INPUT_PARTITIONS = "hazardloom.inputPartitions"
TASK_BYTES = 8 << 20
TERM_TASK_BYTES = 2 << 20  # where every word and word pair of a task is held


def dealt(df: DataFrame, key: str, task_bytes: int | None = None) -> DataFrame:
    """The rows by hash of the key in tasks that grow in number, not in size: a file's row group, which no split cuts, may take
    longer to tag than a whole job should."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    if not n:
        files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
        size = files.agg(F.sum("file_size")).first()[0] or 0
        n = max(-(-size // (task_bytes or TASK_BYTES)), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(int(n), key)


def hash_of(tag: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(tag + "|"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def report_id_of(number: Column) -> Column:
    return padded_id("report_", number)


def narrate(documents: DataFrame) -> DataFrame:
    """Report columns from documents alone; also used on a stream."""
    key = F.col("doc_id")
    description = F.concat_ws(
        " ",
        pick(SETTINGS, hash_of("a", key) % 24),
        pick(OUTCOMES, hash_of("b", key) % 16),
        F.concat(F.lit("Record batch "), hash_of("c", key) % 97, F.lit(".")),
        F.translate("text", ACCENTED, PLAIN),
    )
    edge = key % 50
    score = F.when(edge < 10, pick(EDGE_SCORES, edge)).otherwise((hash_of("p", key) % 10001) / F.lit(10000.0))
    month = F.lpad((1 + hash_of("m", key) % 13).cast("string"), 2, "0")
    return documents.select(
        "doc_id",
        report_id_of(key).alias("report_id"),
        description.alias("description"),
        F.col("text").alias("raw_text"),
        F.col("lang").alias("department"),
        F.col("source").alias("site"),
        F.concat(F.lit("local_"), F.lpad((hash_of("l", key) % 12).cast("string"), 2, "0")).alias("location"),
        pick(LEVEL_NAMES[:5], hash_of("v", key) % 5).alias("actual_level"),
        pick(LEVEL_NAMES, hash_of("w", key) % 6).alias("potential_level"),
        pick(RISKS, hash_of("r", key) % 7).alias("risk"),
        score.alias("p"),
        ((hash_of("q", key) % 10001) / F.lit(10000.0)).alias("p2"),
        F.concat(F.lit("2016-"), month, F.lit("-15")).alias("raw_date"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports; their labels come by `with_labels`, after the narrative is no longer needed."""
    return narrate(dealt(load(spark, sf_dir, "documents"), "doc_id"))


def with_labels(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the label of each report, null where it has none."""
    labels = load(spark, sf_dir, "labels").select(
        report_id_of(F.col("doc_id")).alias("report_id"), F.when(F.col("quality") == 1, "YES").when(F.col("quality") == 0, "NO").alias("label")
    )
    return rows.join(labels, "report_id", "left")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review log: purchases confirm, errors reject, views ask for more; other events are decisions no policy knows."""
    n = load(spark, sf_dir, "documents").select(F.count(F.lit(1)).alias("n"))
    return review_rows(load(spark, sf_dir, "events"), n.scalar())


def review_rows(events: DataFrame, report_count: Column) -> DataFrame:
    decision = (
        F.when(F.col("event_type") == "purchase", "CONFIRMED")
        .when(F.col("event_type") == "error", "REJECTED")
        .when(F.col("event_type") == "view", "NEEDS_MORE_INFO")
        .otherwise(F.upper("event_type"))
    )
    return events.select(
        F.col("event_id").alias("id"),
        report_id_of(F.col("event_id") % report_count).alias("report_id"),
        decision.alias("decision"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("reviewer"),
        F.col("props").alias("note"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports tagged with the current evidence bank and prioritised with the current policy."""
    return triage.priority_v14(tagging.evidence_v15_tags(reports(spark, sf_dir)))


_STORED: dict[tuple, str] = {}


def state_of(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """What tells whether tables have changed: the number of their files, and a sum over paths, sizes and times of change."""
    out = []
    for name in names:
        files = load(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        out.append(tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()))
    return tuple(out)


def stored_once(spark: SparkSession, sf_dir: str, name: str, sources: list[str], build) -> DataFrame:
    """A table that several queries read, built and written when it is first asked for, and again after its sources change."""
    key = (spark.sparkContext.applicationId, sf_dir, name, state_of(spark, sf_dir, sources))
    if key not in _STORED:
        path = shared_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction table on storage: tagged, prioritised and mapped to rule candidates once
    per session and state of the data, then read by every queue and analytics query."""

    def build() -> DataFrame:
        full = extraction.with_activities(rules.rule_candidates(predictions(spark, sf_dir)))
        return full.drop("raw_text").withColumn("activity", first_non_blank(F.col("activities")))

    return stored_once(spark, sf_dir, "predictions", ["documents"], build)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation batch over all reports; about one field in twenty breaks its rule."""
    key = F.col("doc_id")
    draw = lambda tag: hash_of(tag, key) % 20
    rows = with_labels(reports(spark, sf_dir), spark, sf_dir)
    return rows.select(
        "report_id", "description", "label",
        short_hash(norm_for_matching(F.col("raw_text"))).alias("duplicate_group_id"),
        F.when(draw("s") == 0, "draft").when(draw("s") < 5, "pending").otherwise("Completed").alias("annotation_status"),
        F.when(draw("t") == 0, "MAYBE").when(draw("t") < 9, "yes").when(draw("t") < 17, "NO").otherwise("UNCERTAIN").alias("sif_potential"),
        F.when(draw("u") == 0, " ").otherwise("reason").alias("sif_reason"),
        F.when(draw("e") == 0, None).otherwise("evidence").alias("evidence_text"),
        F.when(draw("f") == 0, "SURE").otherwise(pick(["HIGH", "MEDIUM", "low"], hash_of("f", key) % 3)).alias("annotator_confidence"),
        F.when(draw("g") == 0, "").otherwise("annotator").alias("annotator_id"),
        F.when(draw("k") == 0, None).otherwise("2024-01-01T00:00:00").alias("annotated_at_utc"),
    )


def adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second opinions where the labels table has one; toxic rows are still pending."""
    return load(spark, sf_dir, "labels").select(
        report_id_of(F.col("doc_id")).alias("report_id"),
        F.when(F.col("toxic") == 0, "completed").otherwise("pending").alias("adjudication_status"),
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("adjudication_label"),
        F.when(F.col("quality") == 1, "reason").otherwise("").alias("adjudication_reason"),
        F.when(F.col("quality") == 1, "HIGH").otherwise("none").alias("adjudication_confidence"),
        F.lit("adjudicator").alias("adjudicator_id"),
        F.when(F.col("toxic") == 0, "2024-02-01T00:00:00").alias("adjudicated_at_utc"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a YES/NO label and the 0/1 truth."""
    rows = with_labels(reports(spark, sf_dir), spark, sf_dir).where(F.col("label").isNotNull())
    return rows.withColumn("truth", (label_text(F.col("label")) == "YES").cast("int"))
