"""Classify what has no decision yet; confirmed history is never rewritten."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.operators import quarantine
from ledgerloom.operators.history import current_decisions
from ledgerloom.operators.reports import list_undecided, run_summary
from ledgerloom.operators.rules import propose, undecided, usable_rules
from ledgerloom.sources.store import Store


def classify_undecided(
    transactions: DataFrame,
    decisions: DataFrame,
    rules: DataFrame,
    categories: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """Proposals for the transactions without a current decision."""
    waiting = undecided(transactions, current_decisions(decisions))
    if limit is not None:
        waiting = list_undecided(waiting, limit)
    return propose(waiting, usable_rules(rules, categories))


def decisions_from(proposals: DataFrame, as_of: Column, seq: Column) -> DataFrame:
    identity = F.concat_ws(":", F.lit("decision"), "id", seq.cast("string"))
    return proposals.where("status = 'classified'").select(
        keys.name_uuid(identity).alias("id"),
        F.col("id").alias("transaction_id"),
        "nature",
        F.col("proposed_category_id").alias("category_id"),
        F.lit("rule").alias("source"),
        F.col("winning_rule_id").alias("rule_id"),
        "matched_rule_ids",
        F.lit("highest_priority_rule").alias("reason_code"),
        as_of.alias("decided_at"),
        seq.cast("bigint").alias("seq"),
    )


def review_events_from(proposals: DataFrame, as_of: Column, seq: Column) -> DataFrame:
    """Opened for what needs a person, resolved for what was decided."""
    waits = F.col("status") == "pending_review"
    return proposals.select(
        F.col("id").alias("transaction_id"),
        F.when(waits, F.lit("opened")).otherwise(F.lit("resolved")).alias("event"),
        F.col("review_reason").alias("reason"),
        F.when(waits, F.col("matched_rule_ids"))
        .otherwise(F.array().cast("array<string>"))
        .alias("candidate_rule_ids"),
        as_of.alias("event_at"),
        seq.cast("bigint").alias("seq"),
    )


def classify_batch(
    store: Store, batch_id: str, as_of: datetime, seq: int, limit: int | None = None
) -> DataFrame:
    """One stored classification run; returns its one-row summary. ``seq`` grows per run.

    A run that is published already is left alone.
    """
    if store.committed(batch_id, f"{seq}-{limit}"):
        return store.kept(batch_id, "summary")
    decisions = store.read("classification_decisions")
    proposals = store.stage(
        classify_undecided(
            store.read("transactions"),
            decisions,
            store.snapshot("classification_rules"),
            store.snapshot("categories"),
            limit,
        ),
        batch_id,
        "proposals",
    )
    order, instant = F.lit(seq), F.lit(as_of).cast("timestamp")
    made = store.stage(quarantine.decisions(decisions_from(proposals, instant, order)), batch_id, "decisions")
    store.write("classification_decisions", quarantine.kept(made), batch_id)
    store.write("quarantine", quarantine.held(made, "classification_decisions"), batch_id)
    store.write("review_events", review_events_from(proposals, instant, order), batch_id)
    store.keep(run_summary(proposals, current_decisions(decisions)), batch_id, "summary")
    store.commit(batch_id, ["classification_decisions", "review_events", "quarantine"], f"{seq}-{limit}")
    return store.kept(batch_id, "summary")
