"""Jobs that store what people change: categories, rules, and requests for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators.changes import apply_category_changes, apply_rule_changes
from ledgerloom.operators.reviews import request_reviews
from ledgerloom.sources.store import Store


def content_of(frames: list[DataFrame]) -> str:
    """Identity of change rows, in any order."""
    parts = []
    for frame in frames:
        mark = F.xxhash64(*frame.columns).cast("decimal(38,0)")
        found = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(mark), F.lit(0)).alias("mark")).first()
        parts.append(f"{found.n}-{found.mark}")
    return "/".join(parts)


def change_dimensions(store: Store, category_changes: DataFrame, rule_changes: DataFrame, batch_id: str) -> DataFrame:
    """Apply and publish category changes, then rule changes; returns what became of each.

    category_changes: seq, action, name, id. rule_changes: seq, action, id and the rule columns.
    Returns kind (category or rule), seq, action, id, applied, error_code. Publishing the same
    changes again leaves the store alone.
    """
    first = store.stage(category_changes, batch_id, "category-changes")
    second = store.stage(rule_changes, batch_id, "rule-changes")
    content = content_of([first, second])
    if store.committed(batch_id, content):
        store.clear(batch_id)
        return store.kept(batch_id, "results")
    clock = store.clock()
    categories, category_results = apply_category_changes(store.snapshot("categories"), first, clock)
    categories = store.stage(categories, batch_id, "categories")
    rules, rule_results = apply_rule_changes(store.snapshot("classification_rules"), second, categories, clock)
    rules = store.stage(rules, batch_id, "rules")
    columns = ["seq", "action", "id", "applied", "error_code"]
    results = category_results.select(F.lit("category").alias("kind"), *columns).unionByName(
        rule_results.select(F.lit("rule").alias("kind"), *columns)
    )
    store.keep(results, batch_id, "results")
    store.write("categories", categories.select(*schemas.CATEGORY_FIELDS), batch_id)
    store.write("classification_rules", rules, batch_id)
    store.commit(batch_id, ["categories", "classification_rules"], content)
    return store.kept(batch_id, "results")


def request_review_batch(store: Store, requests: DataFrame, batch_id: str) -> None:
    """Open reviews for the requested transactions (transaction_id, event_at, seq) that are stored."""
    asked = store.stage(requests, batch_id, "requests")
    content = content_of([asked])
    if store.committed(batch_id, content):
        store.clear(batch_id)
        return
    store.write("review_events", request_reviews(store.read("transactions"), asked), batch_id)
    store.commit(batch_id, ["review_events"], content)
