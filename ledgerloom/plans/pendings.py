"""Late promotion: corrections of stored pending rows that become transactions after all."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys
from ledgerloom.operators import quarantine
from ledgerloom.operators.dedup import resolve_duplicates
from ledgerloom.operators.validate import apply_corrections, close_corrected, promote
from ledgerloom.plans.ingest import duplicate_rows, stored_months
from ledgerloom.plans.maintain import content_of
from ledgerloom.sources.store import Store

TABLES = ["transactions", "pending_transactions", "duplicate_candidates", "quarantine"]


def current_pendings(store: Store) -> DataFrame:
    """Pending rows as they are now: a closing row takes the place of the open one."""
    rows = store.read("pending_transactions")
    closed = rows.where("status <> 'open'")
    return rows.where("status = 'open'").join(closed.select("id"), "id", "left_anti").unionByName(closed)


def import_order(store: Store) -> DataFrame:
    """import_id, import_seq: the place of each stored import in the order of arrival."""
    file_id = keys.name_uuid(F.col("source_file_hash"))
    micros = F.lpad(F.unix_micros("modification_time").cast("string"), 20, "0")
    return store.read("file_manifest").where("persistence_status = 'stored'").select("import_id", F.concat_ws(":", micros, file_id).alias("import_seq"))


def promote_corrections(store: Store, corrections: DataFrame, batch_id: str, as_of: datetime) -> DataFrame:
    """Correct open pendings, store those that are valid now, and close them; returns what became of each.

    corrections: one row per pending_id with nullable new_<field> columns. Returns pending_id, result
    (transaction, duplicate, pending, or the error) and the codes of the remaining issues. What is
    stored already stands: a corrected row with the key of a stored one is its duplicate, others are
    compared in the order their files arrived. Publishing the same corrections again changes nothing.
    """
    asked = store.stage(corrections, batch_id, "corrections")
    content = content_of([asked])
    if store.committed(batch_id, content):
        store.clear(batch_id)
        return store.kept(batch_id, "results")
    instant = F.lit(as_of).cast("timestamp")
    pendings = current_pendings(store).join(asked.select(F.col("pending_id").alias("id")), "id", "left_semi")
    pendings = store.stage(pendings, batch_id, "pendings")
    corrected = store.stage(apply_corrections(pendings, asked), batch_id, "corrected")
    valid = corrected.where("outcome = 'transaction'").join(import_order(store), "import_id", "left")
    incoming = store.stage(promote(valid.withColumn("created_at", instant)), batch_id, "incoming")
    resolved = resolve_duplicates(
        incoming.withColumn("row_seq", F.col("source_location.row_number")),
        stored_months(store, incoming).withColumn("row_seq", F.col("source_location.row_number")),
    )
    resolved = store.stage(quarantine.transactions(resolved), batch_id, "resolved")
    created = resolved.where("existing_transaction_id is null").select(*schemas.TRANSACTION_FIELDS, "violations")
    store.write("transactions", quarantine.kept(created), batch_id)
    store.write("quarantine", quarantine.held(created, "transactions", F.col("import_id")), batch_id)
    store.write("duplicate_candidates", duplicate_rows(resolved), batch_id)
    store.write("pending_transactions", close_corrected(pendings.where("status = 'open'"), corrected, instant).where("status = 'corrected'"), batch_id)
    # A promoted row is known by its import and line, as its id is made of them.
    place = ["import_id", F.col("source_location.row_number").alias("row_number")]
    repeated = resolved.where("existing_transaction_id is not null").select(*place, F.lit(True).alias("_repeated"))
    results = corrected.withColumn("row_number", F.col("source_location.row_number")).join(repeated, ["import_id", "row_number"], "left").select(
        "pending_id",
        F.coalesce("correction_error", F.when(F.col("_repeated"), F.lit("duplicate")).otherwise(F.col("outcome"))).alias("result"),
        F.when(F.col("correction_error").isNull(), F.transform("issues", lambda i: i["code"])).alias("issues"),
    )
    store.keep(results, batch_id, "results")
    store.commit(batch_id, TABLES, content)
    return store.kept(batch_id, "results")
