"""Corrections by people: new decisions, an audit trail, and rules worth remembering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys
from ledgerloom.functions.text import normalize_text
from ledgerloom.operators import quarantine
from ledgerloom.operators.changes import apply_rule_changes
from ledgerloom.operators.history import current_decisions
from ledgerloom.operators.runs import neighbours
from ledgerloom.operators.skew import HOT_ROWS_MIN, hot_keys, lookup, lookup_dimension
from ledgerloom.plans.maintain import content_of
from ledgerloom.sources.store import Store, stage_shared

REMEMBERED_NAME = "Remembered by user"


@dataclass
class Corrections:
    decisions: DataFrame
    corrections: DataFrame
    review_events: DataFrame
    rules: DataFrame
    errors: DataFrame


def check_requests(
    requests: DataFrame, transactions: DataFrame, categories: DataFrame, hot_rows_min: int = HOT_ROWS_MIN
) -> DataFrame:
    """Requests with description_normalized, source_institution, category_id and error_code."""
    facts = transactions.select(
        F.col("id").alias("transaction_id"),
        "description_normalized",
        "source_institution",
        F.lit(True).alias("_known"),
    )
    counts = requests.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n"))
    found = lookup(
        requests, facts, ["transaction_id"], ["seq"], hot_keys(counts, ["transaction_id"], "_n", hot_rows_min)
    )
    active = categories.where("is_active").select(
        F.col("normalized_name").alias("_name"), F.col("id").alias("category_id")
    )
    named = lookup_dimension(
        found.withColumn("_name", normalize_text(F.col("category_name"))), active, ["_name"], ["seq"]
    )
    needs = F.col("nature").isin(*schemas.NATURES_WITH_CATEGORY)
    code = (
        F.when(F.col("_known").isNull(), F.lit("transaction_not_found"))
        .when(
            F.col("category_name").isNotNull() & F.col("category_id").isNull(),
            F.lit("active_category_not_found"),
        )
        .when(~F.coalesce(F.col("nature").isin(*schemas.NATURES), F.lit(False)), F.lit("unknown_nature"))
        .when(needs & F.col("category_id").isNull(), F.lit("expense_or_income_requires_active_category"))
        .when(F.col("remember") & ~F.col("rule_priority").between(1, 1000), F.lit("priority_out_of_range"))
    )
    return named.withColumn("error_code", code).drop("_known", "_name")


def correct_classifications(
    requests: DataFrame,
    transactions: DataFrame,
    categories: DataFrame,
    rules: DataFrame,
    decisions: DataFrame,
    hot_rows_min: int = HOT_ROWS_MIN,
    clock: int = 0,
) -> Corrections:
    """Apply a batch of requests: seq, transaction_id, nature, category_name, remember,
    rule_priority, requested_at. ``seq`` is unique and grows with time; ``clock`` places the
    rules made here among those of other batches.
    """
    # Read by every table made below.
    checked = stage_shared(check_requests(requests, transactions, categories, hot_rows_min), "checked-requests")
    accepted = checked.where("error_code is null").withColumn(
        "decision_id", keys.name_uuid(F.concat_ws(":", F.lit("decision"), "transaction_id", F.col("seq").cast("string")))
    )
    absent = F.lit(None).cast("string")
    wanted = accepted.where("remember").select(
        "seq",
        F.lit("create").alias("action"),
        absent.alias("id"),
        F.lit(REMEMBERED_NAME).alias("name"),
        F.col("rule_priority").cast("int").alias("priority"),
        "nature",
        "category_id",
        F.col("description_normalized").alias("description_exact"),
        absent.alias("merchant_exact"),
        absent.alias("counterparty_exact"),
        "source_institution",
        absent.alias("card_alias"),
        F.lit(True).alias("created_by_user"),
    )
    rules_after, remembered = apply_rule_changes(rules, wanted, categories, clock)
    new_decisions = accepted.select(
        F.col("decision_id").alias("id"),
        "transaction_id",
        "nature",
        "category_id",
        F.lit("user").alias("source"),
        absent.alias("rule_id"),
        F.array().cast("array<string>").alias("matched_rule_ids"),
        F.lit("user_correction").alias("reason_code"),
        F.col("requested_at").alias("decided_at"),
        "seq",
    )
    # The decision a correction replaces: the stored current one or an earlier request.
    timeline = ["id", "transaction_id", "decided_at", "seq", "is_new"]
    touched = accepted.select("transaction_id").distinct()
    before = current_decisions(decisions).join(touched, "transaction_id", "left_semi")
    both = new_decisions.withColumn("is_new", F.lit(True)).select(*timeline).unionByName(
        before.withColumn("is_new", F.lit(False)).select(*timeline)
    )
    linked = neighbours(
        both,
        "transaction_id",
        ["decided_at", "seq", "id"],
        ["id"],
        following=False,
        hot_rows_min=hot_rows_min,
    ).where("is_new")
    rule_of = remembered.where("error_code is null").select("seq", F.col("id").alias("remembered_rule_id"))
    corrections = linked.join(rule_of, "seq", "left").select(
        keys.name_uuid(F.concat(F.lit("correction:"), "id")).alias("id"),
        "transaction_id",
        F.col("previous_id").alias("previous_decision_id"),
        F.col("id").alias("new_decision_id"),
        "remembered_rule_id",
        F.col("decided_at").alias("created_at"),
    )
    resolved = accepted.select(
        "transaction_id",
        F.lit("resolved").alias("event"),
        absent.alias("reason"),
        F.array().cast("array<string>").alias("candidate_rule_ids"),
        F.col("requested_at").alias("event_at"),
        "seq",
    )
    errors = checked.where("error_code is not null").select("seq", "transaction_id", "error_code")
    return Corrections(new_decisions, corrections, resolved, rules_after, errors)


def correct_batch(store: Store, requests: DataFrame, batch_id: str) -> DataFrame:
    """Apply and publish a batch of correction requests; returns the refused ones.

    A batch that is published already is left alone if the requests are the same, and a
    BatchConflict if not. Everything is worked out before the first table is written.
    """
    asked = store.stage(requests, batch_id, "requests")
    content = content_of([asked])
    if store.committed(batch_id, content):
        store.clear(batch_id)
        return store.kept(batch_id, "errors")
    result = correct_classifications(
        asked,
        store.read("transactions"),
        store.snapshot("categories"),
        store.snapshot("classification_rules"),
        store.read("classification_decisions"),
        clock=store.clock(),
    )
    made = store.stage(quarantine.decisions(result.decisions), batch_id, "checked-decisions")
    tables = {
        "classification_rules": result.rules,
        "classification_decisions": quarantine.kept(made),
        "quarantine": quarantine.held(made, "classification_decisions"),
        "classification_corrections": result.corrections,
        "review_events": result.review_events,
    }
    ready = {table: store.stage(frame, batch_id, table) for table, frame in tables.items()}
    store.keep(result.errors, batch_id, "errors")
    for table, frame in ready.items():
        store.write(table, frame, batch_id)
    store.commit(batch_id, [*tables], content)
    return store.kept(batch_id, "errors")
