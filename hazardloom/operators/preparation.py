"""Canonical reports, duplicate groups, annotation pool, label resolution, merging and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions import text as tx
from hazardloom.functions.ordered import join_groups, keep_first, with_row_number

# Text columns, nullable flags and list columns of the canonical report.
TEXT_FIELDS = [
    "report_id", "source", "report_type", "timestamp", "site", "location", "department", "activity", "asset",
    "description", "actual_outcome", "potential_accident_level", "sif_potential", "annotation_confidence",
    "annotation_version", "source_gender", "source_actor_type",
]
FLAG_FIELDS = ["unsafe_act", "unsafe_condition", "near_miss", "hi_po"]
LIST_FIELDS = ["hazards", "exposure", "potential_consequences", "barriers", "barrier_status", "life_saving_rules"]
RAW_COLUMNS = {
    "index": "Unnamed: 0", "date": "Data", "country": "Countries", "local": "Local", "sector": "Industry Sector",
    "actual": "Accident Level", "potential": "Potential Accident Level", "gender": "Genre",
    "actor": "Employee or Third Party", "risk": "Critical Risk", "text": "Description",
}


def canonical_reports(raw: DataFrame, source: str = "industrial_safety") -> DataFrame:
    """Raw incident rows to the canonical schema; blank text becomes null, the risk list is split on ';'."""
    r = {k: F.col(f"`{v}`") for k, v in RAW_COLUMNS.items()}
    known = {
        "report_id": tx.padded_id(f"{source}_", r["index"].try_cast("double").cast("bigint")),
        "source": F.lit(source),
        "report_type": F.lit("incident"),
        "timestamp": tx.lenient_timestamp(tx.clean(r["date"])),
        "site": tx.clean(r["country"]),
        "location": tx.clean(r["local"]),
        "department": tx.clean(r["sector"]),
        "description": tx.clean(r["text"]),
        "actual_outcome": tx.clean(r["actual"]),
        "potential_accident_level": tx.clean(r["potential"]),
        "source_gender": tx.clean(r["gender"]),
        "source_actor_type": tx.clean(r["actor"]),
        "hazards": tx.split_list(r["risk"]),
    }
    columns = [known.get(c, F.lit(None).cast("string")).alias(c) for c in TEXT_FIELDS]
    columns += [F.lit(None).cast("boolean").alias(c) for c in FLAG_FIELDS]
    columns += [known.get(c, F.array().cast("array<string>")).alias(c) for c in LIST_FIELDS]
    return raw.select(*columns)


def text_key(c: Column) -> Column:
    """Digest of the duplicate-matching form; shuffles carry 64 characters, not the narrative."""
    return F.sha2(tx.norm_for_matching(c), 256)


def duplicate_groups(df: DataFrame, text: str, id_column: str) -> DataFrame:
    """Members of every group of equal normalised texts with two or more rows, in long form: a
    group may be any share of the table, so its ids are rows, never one list."""
    keyed = df.select(F.col(id_column), text_key(F.col(text)).alias("group_key"))
    sizes = keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("record_count")).where("record_count > 1")
    return join_groups(keyed, sizes, "group_key", "record_count").select("group_key", "record_count", id_column)


def numbered_groups(df: DataFrame, text: str) -> DataFrame:
    """Adds duplicate_group_id (DUP_0001 in the order of the normalised texts), its size and is_duplicate."""
    keyed = df.withColumn("_norm", tx.norm_for_matching(F.col(text))).withColumn("_key", F.sha2("_norm", 256))
    groups = keyed.groupBy("_key").agg(F.min("_norm").alias("_norm"), F.count(F.lit(1)).alias("duplicate_group_size"))
    numbered = with_row_number(groups, [F.col("_norm")], "_no").select(
        "_key",
        "duplicate_group_size",
        F.concat(F.lit("DUP_"), F.lpad(F.col("_no").cast("string"), F.greatest(F.lit(4), F.length(F.col("_no").cast("string"))), F.lit("0"))).alias("duplicate_group_id"),
    )
    joined = join_groups(keyed.drop("_norm"), numbered, "_key", "duplicate_group_size").drop("_key")
    return joined.withColumn("is_duplicate", F.col("duplicate_group_size") > 1)


def hashed_groups(df: DataFrame, text: str) -> DataFrame:
    """Group ids from the text alone, without any global order."""
    return df.withColumn("derived_group_id", tx.short_hash(tx.norm_for_matching(F.col(text))))


def annotation_pool(grouped: DataFrame, level: str, id_column: str) -> DataFrame:
    """One representative per duplicate group: highest potential level, then lowest id."""
    ranked = grouped.withColumn("potential_level_numeric", tx.level_number(F.col(level)))
    order = [F.col("potential_level_numeric").desc_nulls_last(), F.col(id_column)]
    return keep_first(ranked, ["duplicate_group_id"], order)


def union_completed(frames: list[DataFrame | None]) -> DataFrame:
    """Union of the annotation tables that exist, whatever their columns, completed rows only."""
    present = [f for f in frames if f is not None]
    out = present[0]
    for other in present[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.where(F.lower(F.trim(F.col("annotation_status"))) == "completed")


def resolve_labels(pilot: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """Adjudicated labels replace pilot labels; only YES, NO and UNCERTAIN survive."""
    done = adjudicated.where(F.lower(F.trim("adjudication_status")) == "completed").select(
        "report_id", tx.label_text(F.col("adjudication_label")).alias("_new")
    )
    joined = pilot.join(done, "report_id", "left")
    final = F.coalesce("_new", tx.label_text(F.coalesce("sif_potential", F.lit(""))))
    return (
        joined.withColumns(
            {
                "final_sif_potential": final,
                "label_source": F.when(F.col("_new").isNotNull(), "adjudicated").otherwise("pilot"),
            }
        )
        .drop("_new")
        .where(F.col("final_sif_potential").isin("YES", "NO", "UNCERTAIN"))
        .withColumns(
            {
                "is_uncertain": F.col("final_sif_potential") == "UNCERTAIN",
                "usable_for_binary_sif_model": F.col("final_sif_potential").isin("YES", "NO"),
            }
        )
    )


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of resolved and newly completed binary labels under one canonical label column."""
    fresh = new.where(
        tx.label_text(F.col("sif_potential")).isin("YES", "NO")
        & (F.lower(F.trim(F.coalesce("annotation_status", F.lit("completed")))) == "completed")
    )
    both = old.unionByName(fresh, allowMissingColumns=True)
    label = tx.label_text(F.coalesce("final_sif_potential", "sif_potential"))
    return both.withColumn("final_sif_potential", label).where(F.col("final_sif_potential").isin("YES", "NO"))


def not_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that break a one-to-one or many-to-one join."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def validated_join(left: DataFrame, right: DataFrame, key: str, one_to_one: bool = True) -> tuple[DataFrame, DataFrame]:
    """Left join of which the relation is checked: the rows, and the keys that break it.

    Rows: each left row once; a key without a right row, or with several, gets nulls. Broken keys (key, left_rows, right_rows,
    problem): 'right_repeated', 'left_repeated' (only one to one), 'missing'. The right side is cut to a row and a count per key
    before it is shuffled, and the counts travel beside the rows, so rows and report need one shuffle of either side."""
    counted, first = free_columns([*left.columns, *right.columns], 2)
    others = [c for c in right.columns if c != key]
    single = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(counted), F.first(F.struct(*others)).alias(first))
    joined = left.join(single, key, "left")
    rows = joined.select(*left.columns, *[F.when(F.col(counted) == 1, F.col(first)[c]).alias(c) for c in others])
    seen = joined.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"), F.coalesce(F.max(counted), F.lit(0)).alias("right_rows"))
    problem = F.when(F.col("right_rows") == 0, "missing").when(F.col("right_rows") > 1, "right_repeated")
    if one_to_one:
        problem = problem.when(F.col("left_rows") > 1, "left_repeated")
    return rows, seen.withColumn("problem", problem).where(F.col("problem").isNotNull())


def free_columns(taken: list[str], n: int) -> list[str]:
    """Names that no column has, in whatever case."""
    known = {c.lower() for c in taken}
    return [x for x in (f"_made{i}" for i in range(n + len(known))) if x not in known][:n]


def with_metadata(predictions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on report_id; a blank activity falls back to the extracted activities."""
    joined = predictions.join(metadata, "report_id", "left")
    own = F.col("activity") if "activity" in joined.columns else F.lit(None).cast("string")
    return joined.withColumn("activity", tx.first_non_blank(own, F.col("activities")))


def latest_review(reviews: DataFrame) -> DataFrame:
    """Newest review per report by id, from partial aggregates."""
    fields = ["decision", "reviewer", "note", "created_at"]
    return reviews.groupBy("report_id").agg(F.max("id").alias("id"), *[F.max_by(c, "id").alias(c) for c in fields])


def with_review_status(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds review_status, UNREVIEWED without a review."""
    newest = latest_review(reviews).select("report_id", F.col("decision").alias("_d"))
    return rows.join(newest, "report_id", "left").withColumn("review_status", F.coalesce("_d", F.lit("UNREVIEWED"))).drop("_d")


def valid_reviews(reviews: DataFrame, reports: DataFrame) -> DataFrame:
    """Reviews of known reports, with trimmed reviewer and note."""
    known = reviews.join(reports.select("report_id"), "report_id", "left_semi")
    return known.withColumns({"reviewer": F.trim("reviewer"), "note": F.trim("note")})


def join_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key with where it was found: both, left_only or right_only."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    origin = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, origin.alias("origin"))


def prepare_batch(selected: DataFrame, pool: DataFrame) -> DataFrame:
    """Selected ids with the pool's text as authority and the annotation fields at their defaults."""
    joined = selected.join(pool.select("report_id", F.col("description").alias("_pool"), "site", "department"), "report_id", "left")
    blanks = ["sif_potential", "sif_reason", "evidence_text", "annotator_confidence", "annotator_id"]
    return joined.withColumns(
        {
            "description": F.coalesce("_pool", "description"),
            "annotation_status": F.lit("pending"),
            "annotation_round": F.lit("active_learning"),
            "annotation_version": F.lit("v0.2"),
            **{c: F.lit("") for c in blanks},
        }
    ).drop("_pool")
