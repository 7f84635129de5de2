"""Review queue derived from an append-only event table.

Events are ``opened`` (with reason and candidate rules) and ``resolved``. All opened
events since the last resolution form one review: it keeps the identity and time of
the first and shows the reason and candidates of the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.operators.runs import running_count
from ledgerloom.operators.skew import HOT_ROWS_MIN, hot_keys, lookup

ORDER = ["event_at", "seq"]


def _review_id() -> Column:
    return keys.name_uuid(F.concat_ws(":", F.lit("review"), "transaction_id", F.col("episode").cast("string")))


def reviews(events: DataFrame, hot_rows_min: int = HOT_ROWS_MIN) -> DataFrame:
    """Every review, open or resolved, one row per (transaction, episode)."""
    numbered = running_count(
        events,
        "transaction_id",
        ORDER,
        F.col("event") == "resolved",
        "episode",
        hot_rows_min,
    )
    opened = F.col("event") == "opened"
    at = F.struct(*ORDER)
    last = F.max_by(F.struct("reason", "candidate_rule_ids"), F.when(opened, at))
    grouped = (
        numbered.groupBy("transaction_id", "episode")
        .agg(
            F.min(F.when(opened, at)).alias("first"),
            last.alias("last"),
            F.min(F.when(~opened, F.col("event_at"))).alias("resolved_at"),
        )
        .where("first is not null")
    )
    return grouped.select(
        _review_id().alias("id"),
        "transaction_id",
        F.when(F.col("resolved_at").isNull(), F.lit("open")).otherwise(F.lit("resolved")).alias("status"),
        F.col("last.reason").alias("reason"),
        F.array_sort(F.coalesce("last.candidate_rule_ids", F.array().cast("array<string>"))).alias(
            "candidate_rule_ids"
        ),
        F.col("first.event_at").alias("created_at"),
        "resolved_at",
        F.col("episode"),
    )


def open_reviews(events: DataFrame, hot_rows_min: int = HOT_ROWS_MIN) -> DataFrame:
    """The reviews that are open: what was opened after the last resolution, without the episodes before.

    The last resolution of each transaction is a map-side combined maximum; no history is sorted.
    """
    at = F.struct(*ORDER)
    closed = events.where("event = 'resolved'").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("episode"), F.max(at).alias("closed_at"))
    opened = events.where("event = 'opened'")
    counts = opened.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n"))
    dated = lookup(opened, closed, ["transaction_id"], ["seq"], hot_keys(counts, ["transaction_id"], "_n", hot_rows_min))
    later = dated.where(F.col("closed_at").isNull() | (at > F.col("closed_at")))
    grouped = later.groupBy("transaction_id").agg(
        F.coalesce(F.max("episode"), F.lit(0)).cast("bigint").alias("episode"),
        F.min(at).alias("first"),
        F.max_by(F.struct("reason", "candidate_rule_ids"), at).alias("last"),
    )
    return grouped.select(
        _review_id().alias("id"),
        "transaction_id",
        F.col("last.reason").alias("reason"),
        F.array_sort(F.coalesce("last.candidate_rule_ids", F.array().cast("array<string>"))).alias("candidate_rule_ids"),
        F.col("first.event_at").alias("created_at"),
    )


def request_reviews(transactions: DataFrame, requests: DataFrame) -> DataFrame:
    """Opened events for transactions a user wants reviewed, even decided ones.

    ``requests``: transaction_id, event_at, seq. Unknown transactions give no event.
    """
    known = transactions.select(F.col("id").alias("transaction_id"))
    return requests.join(known, "transaction_id", "left_semi").select(
        "transaction_id",
        F.lit("opened").alias("event"),
        F.lit("user_requested").alias("reason"),
        F.array().cast("array<string>").alias("candidate_rule_ids"),
        "event_at",
        "seq",
    )
