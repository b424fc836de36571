"""Registered queries: sentence-scoped ontology extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.operators import ontology
from hazardloom.plans.tables import reports


def extract_v01(spark, sf):
    return ontology.extract_v01(reports(spark, sf).select("report_id", "description"))


def extract_v01_summary(spark, sf):
    return ontology.ontology_summary(extract_v01(spark, sf))


def extract_v02(spark, sf):
    return ontology.extract_v02(reports(spark, sf).select("report_id", "description"))


def extract_v03(spark, sf):
    return ontology.extract_v03(reports(spark, sf).select("report_id", "description"))


def guard_rails(spark, sf):
    rows = reports(spark, sf).select("report_id", F.explode(ontology.guard_rails(F.col("description"))).alias("dropped"))
    return rows


QUERIES = {
    "extract_v01": extract_v01, "extract_v01_summary": extract_v01_summary, "extract_v02": extract_v02,
    "extract_v03": extract_v03, "guard_rails": guard_rails,
}
