"""Decision history: append-only rows, with what is current derived from order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.runs import neighbours
from ledgerloom.operators.skew import HOT_ROWS_MIN, lookup_dimension


def decision_history(
    decisions: DataFrame, categories: DataFrame | None = None, hot_rows_min: int = HOT_ROWS_MIN
) -> DataFrame:
    """Adds superseded_at and is_current, and category_name when categories are given."""
    dated = neighbours(
        decisions,
        "transaction_id",
        ["decided_at", "seq", "id"],
        ["decided_at"],
        following=True,
        hot_rows_min=hot_rows_min,
    ).withColumnRenamed("next_decided_at", "superseded_at")
    out = dated.withColumn("is_current", F.col("superseded_at").isNull())
    if categories is None:
        return out
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return lookup_dimension(out, names, ["category_id"], ["id"])


def current_decisions(decisions: DataFrame) -> DataFrame:
    """Latest decision per transaction, as a map-side combined maximum."""
    rest = [c for c in decisions.columns if c not in ("transaction_id", "decided_at", "seq", "id")]
    latest = F.max_by(
        F.struct("decided_at", "seq", "id", *rest), F.struct("decided_at", "seq", "id")
    )
    return (
        decisions.groupBy("transaction_id")
        .agg(latest.alias("d"))
        .select("transaction_id", "d.*")
        .select(*decisions.columns)
    )


def rows_for(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``column`` is among the ids of the one-column ``wanted``."""
    (name,) = wanted.columns
    return table.join(wanted.select(F.col(name).alias(column)).distinct(), column, "left_semi")
