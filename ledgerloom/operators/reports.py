"""Counts, redacted views and bounded listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import RULE_CRITERIA
from ledgerloom.operators.history import current_decisions
from ledgerloom.operators.reviews import open_reviews
from ledgerloom.operators.rules import usable_rules


def route(rows: DataFrame) -> DataFrame:
    """Adds route: each source row counts exactly once.

    Rejection comes first, then repetition inside the file, then validation.
    """
    return rows.withColumn(
        "route",
        F.when(F.col("rejected_reason").isNotNull(), F.lit("rejected"))
        .when(F.col("is_duplicate"), F.lit("duplicate"))
        .otherwise(F.col("outcome")),
    )


def row_issue_codes() -> Column:
    """Codes one routed row adds to the issue counts of its file."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(F.col("route") == "rejected", F.array("rejected_reason")).otherwise(F.col("warnings")),
        F.when(F.col("route") == "duplicate", F.array(F.lit("duplicate_record")))
        .when(F.col("route") == "rejected", none)
        .otherwise(F.transform("issues", lambda i: i["code"])),
    )


_ROUTE_COUNTS = {
    "transactions_created": "transaction",
    "pending_created": "pending",
    "duplicates_found": "duplicate",
    "records_rejected": "rejected",
}


def import_totals(routed: DataFrame, keys: list[str]) -> DataFrame:
    """Balanced counts and the issue_counts map (null without issues) per import, in one pass.

    Each row counts once under no code and once under each of its codes, so one aggregation over
    (keys, code) has both; ``balanced`` must be true for every row.
    """
    coded = routed.select(*keys, "route", row_issue_codes().alias("codes"))
    own = F.array(F.lit(None).cast("string"))
    marked = coded.select(*keys, "route", (F.size("codes") > 0).alias("has"), F.explode(F.concat(own, "codes")).alias("code"))
    each = marked.groupBy(*keys, "code").agg(
        F.count(F.lit(1)).alias("records_read"),
        *[F.count_if(F.col("route") == value).alias(name) for name, value in _ROUTE_COUNTS.items()],
        F.count_if("has").alias("rows_with_issues"),
    )
    names = ["records_read", *_ROUTE_COUNTS, "rows_with_issues"]
    entries = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", F.col("records_read").alias("n"))))
    summed = each.groupBy(*keys).agg(*[F.max(F.when(F.col("code").isNull(), F.col(c))).alias(c) for c in names], entries.alias("entries"))
    total = reduce(lambda a, b: a + b, [F.col(name) for name in _ROUTE_COUNTS])
    issues = F.when(F.size("entries") > 0, F.map_from_entries(F.sort_array("entries")))
    return summed.withColumn("balanced", total == F.col("records_read")).withColumn("issue_counts", issues).drop("entries")


def completion_status(has_issues: Column) -> Column:
    return F.when(has_issues, F.lit("completed_with_issues")).otherwise(F.lit("completed"))


def _one_row(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with one counted column per named single-row aggregate."""
    stacked = reduce(
        DataFrame.unionByName,
        [frame.select(F.lit(name).alias("metric"), F.col("n").cast("bigint")) for name, frame in parts.items()],
    )
    return stacked.agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("n"))), F.lit(0)).alias(name) for name in parts]
    )


def _count(frame: DataFrame, condition: str | None = None) -> DataFrame:
    rows = frame if condition is None else frame.where(condition)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def store_summary(
    import_runs: DataFrame, transactions: DataFrame, pendings: DataFrame, duplicates: DataFrame
) -> DataFrame:
    return _one_row(
        {
            "import_attempts": _count(import_runs),
            "completed_imports": _count(import_runs, "persistence_status = 'stored'"),
            "transactions": _count(transactions),
            "open_pending": _count(pendings, "status = 'open'"),
            "duplicate_candidates": _count(duplicates, "status in ('open_review', 'confirmed_duplicate')"),
        }
    )


def classification_summary(
    categories: DataFrame,
    rules: DataFrame,
    decisions: DataFrame,
    review_events: DataFrame,
    corrections: DataFrame,
) -> DataFrame:
    return _one_row(
        {
            "active_categories": _count(categories, "is_active"),
            "enabled_rules": _count(usable_rules(rules, categories)),
            "classified_transactions": _count(current_decisions(decisions)),
            "open_reviews": _count(open_reviews(review_events)),
            "corrections": _count(corrections),
        }
    )


def run_summary(proposals: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts of one classification run; ``skipped`` holds the current decisions."""
    # One pass over the proposals, whose plan holds the whole rule match.
    counted = proposals.agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(F.col("status") == "classified").alias("classified"),
        F.count_if(F.col("status") == "pending_review").alias("pending_review"),
        F.lit(0).cast("bigint").alias("skipped_with_decision"),
    )
    none = [F.lit(0).cast("bigint").alias(c) for c in counted.columns[:-1]]
    before = skipped.agg(F.count(F.lit(1)).alias("skipped_with_decision")).select(*none, "skipped_with_decision")
    both = counted.unionByName(before)
    return both.agg(*[F.sum(c).alias(c) for c in counted.columns])


def classifier_view(transactions: DataFrame) -> DataFrame:
    """The ten fields a classifier may see, keyed by transaction."""
    return transactions.select(
        F.col("id").alias("transaction_id"),
        "transaction_date",
        "amount_minor",
        "currency",
        F.col("description_normalized").alias("description"),
        "source_institution",
        "payment_method",
        "payment_instrument",
        "card_alias",
        "counterparty_name",
        "merchant_name",
    )


def redacted_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.select(
        "id",
        "transaction_id",
        "reason",
        F.size("candidate_rule_ids").alias("candidate_rules"),
        "created_at",
    )


def redacted_rules(rules: DataFrame) -> DataFrame:
    """Rules with the number of criteria instead of their values."""
    criteria = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in RULE_CRITERIA])
    return rules.select(
        "id", "name", "priority", "nature", "category_name", "is_enabled", criteria.alias("criteria")
    )


def _bounded(frame: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return frame
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return frame.limit(limit)


def list_undecided(frame: DataFrame, limit: int | None = 500) -> DataFrame:
    return _bounded(frame.orderBy("transaction_date", "created_at", "id"), limit)


def list_open_pending(pendings: DataFrame, limit: int | None = 100) -> DataFrame:
    return _bounded(pendings.where("status = 'open'").orderBy("created_at", "id"), limit)


def list_open_reviews(reviews: DataFrame, limit: int | None = 100) -> DataFrame:
    return _bounded(reviews.orderBy("created_at", "id"), limit)


def list_categories(categories: DataFrame, active_only: bool = False) -> DataFrame:
    rows = categories.where("is_active") if active_only else categories
    return rows.orderBy("normalized_name")


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("priority"), "created_seq", "id")


def list_history(history: DataFrame) -> DataFrame:
    return history.orderBy("transaction_id", "decided_at", "seq", "id")


# Columns a printed report may hold: states, codes and counts only.
SAFE_COLUMNS = [
    "detection_status",
    "ingestion_status",
    "persistence_status",
    "format_id",
    "source_institution",
    "records_read",
    "transactions_created",
    "pending_created",
    "duplicates_in_file",
    "duplicates_in_database",
    "records_rejected",
    "issue_counts",
    "error_code",
]


def safe_report(import_runs: DataFrame) -> DataFrame:
    """One JSON line per import without values, descriptions, names or hashes."""
    return import_runs.select(
        F.col("id").alias("import_id"), F.to_json(F.struct(*SAFE_COLUMNS)).alias("report")
    )
