"""Decide per file whether its rows may be read; the first reason found wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate_files(detected: DataFrame) -> DataFrame:
    """Adds ingestion_status (``processed`` or ``blocked``) and gate_code.

    Needs issue_code, detection_status, drift_breaking and, for layouts nobody
    approved yet, approval_institution, approval_currency and approval_error.
    """
    generic = F.col("detection_status") == "generic"
    code = (
        F.when(F.col("issue_code").isNotNull(), F.col("issue_code"))
        .when(F.col("detection_status") == "ambiguous", F.lit("ambiguous_format"))
        .when(F.col("detection_status") == "unknown", F.lit("missing_minimum_column"))
        .when(
            generic & F.col("approval_institution").isNull(),
            F.lit("generic_mapping_requires_approval"),
        )
        .when(generic & F.col("approval_currency").isNull(), F.lit("missing_currency"))
        .when(generic & F.col("approval_error").isNotNull(), F.col("approval_error"))
        .when(F.col("drift_breaking"), F.lit("breaking_drift"))
    )
    return detected.withColumn("gate_code", code).withColumn(
        "ingestion_status",
        F.when(F.col("gate_code").isNull(), F.lit("processed")).otherwise(F.lit("blocked")),
    )


def blocked_issue_counts(gated: DataFrame) -> DataFrame:
    """(path, code, count) of blocked files: the gate code, or every drift change."""
    codes = F.when(
        F.col("gate_code") == "breaking_drift", F.transform("drift", lambda c: c["code"])
    ).otherwise(F.array("gate_code"))
    return (
        gated.where("ingestion_status = 'blocked'")
        .select("path", F.explode(codes).alias("code"))
        .groupBy("path", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
