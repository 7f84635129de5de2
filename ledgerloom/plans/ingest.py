"""From a folder of statement files to stored transactions, in one batch.

Files that the manifest knows by path, time and length are not opened again. The bytes
of the others are read and parsed once (large files by ranges, see ``sources.ranges``);
the parsed files are written to the staging folder and every later step starts from
there. Rows are shuffled by record hash (repeats inside a file) and by the narrow
deduplication keys, never by file bytes.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys
from ledgerloom.operators import quarantine
from ledgerloom.operators.dedup import mark_in_file_duplicates, resolve_duplicates, skip_imported
from ledgerloom.operators.detect import detect_formats
from ledgerloom.operators.drift import with_drift
from ledgerloom.operators.extract import extract_candidates, with_positions
from ledgerloom.operators.gate import blocked_issue_counts, gate_files
from ledgerloom.operators.reports import (
    completion_status,
    import_totals,
    route,
    safe_report,
    store_summary,
)
from ledgerloom.operators.skew import is_small
from ledgerloom.operators.validate import candidate_struct, promote, to_pending, validate_candidates
from ledgerloom.sources.files import SPLIT_BYTES, escaped_path, explode_records, list_files, profile_files, read_files, refused_files, suffix_is_supported
from ledgerloom.sources.formats import all_specs, approval_error, learn_specs, read_registry, upsert_specs
from ledgerloom.sources.ranges import profile_ranges
from ledgerloom.sources.store import Store

NO_APPROVALS = "path string, institution string, currency string, date_order string, approval_seq bigint"
INGEST_TABLES = ["transactions", "pending_transactions", "duplicate_candidates", "import_runs", "file_manifest", "quarantine"]


def arrival_order() -> Column:
    """Sortable text: older files first, equal times by content identity."""
    return F.concat_ws(
        ":", F.lpad(F.unix_micros(F.col("modificationTime").cast("timestamp")).cast("string"), 20, "0"), "file_id"
    )


def learn_approved(files: DataFrame, approvals: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry with the layouts this batch approves; the first approval of a layout counts."""
    generic = detect_formats(files, all_specs(files.sparkSession, registry)).where(
        "detection_status = 'generic'"
    )
    asked = approvals.join(generic, "path").where("institution is not null and currency is not null")
    asked = asked.withColumn("mapping", F.col("suggested_mapping"))
    valid = asked.where(approval_error(F.col("mapping")).isNull())
    wanted = ["columns", "delimiter", "mapping", "institution", "currency", "date_order"]
    first = valid.groupBy("signature").agg(
        F.min_by(F.struct(*wanted), F.struct("approval_seq", "path")).alias("a"),
        F.min("approval_seq").alias("approval_seq"),
    )
    return upsert_specs(registry, learn_specs(first.select("signature", "approval_seq", "a.*")))


def examine_files(parsed: DataFrame, specs: DataFrame, approvals: DataFrame) -> DataFrame:
    """Detection, drift and gate for every parsed file."""
    detected = with_drift(detect_formats(parsed, specs))
    asked = approvals.groupBy("path").agg(
        F.min_by(F.struct("institution", "currency", "date_order"), "approval_seq").alias("a")
    )
    # Approvals are given by people; join them to files by their unique path.
    joined = detected.join(asked, "path", "left")
    error = approval_error(F.col("suggested_mapping"))
    with_error = (
        joined.withColumn("institution", F.col("a.institution"))
        .withColumn("currency", F.col("a.currency"))
        .withColumn("date_order", F.col("a.date_order"))
        .withColumn("approval_error", error)
        .withColumnRenamed("institution", "approval_institution")
        .withColumnRenamed("currency", "approval_currency")
        .drop("a", "date_order")
    )
    return gate_files(with_error)


def candidate_rows(records: DataFrame) -> DataFrame:
    """Data records with their file's spec -> candidates, without the source cells.

    Needs import_id, file_id, row_number, cells, columns, spec, at.
    """
    return extract_candidates(records).drop("cells", "columns", "spec", "at")


def route_rows(candidates: DataFrame) -> DataFrame:
    """Every candidate row on exactly one route.

    The input is read twice (to find firsts and to mark repeats), so hand in stored
    rows rather than a plan that still has to parse text.
    """
    # Rejected rows take no part in repetition: they are keyed apart by their line.
    rejected = F.col("rejected_reason").isNotNull()
    keyed = candidates.withColumn("_hash", F.col("source_record_hash")).withColumn(
        "source_record_hash",
        F.when(rejected, F.concat_ws(":", F.lit("rejected"), "row_number")).otherwise(F.col("source_record_hash")),
    )
    marked = mark_in_file_duplicates(keyed).withColumn("source_record_hash", F.col("_hash")).drop("_hash")
    return route(validate_candidates(marked))


def ingest_batch(
    spark: SparkSession,
    store: Store,
    path: str,
    batch_id: str,
    as_of: datetime | None,
    approvals: DataFrame | None = None,
    requested: DataFrame | None = None,
    files: DataFrame | None = None,
    max_bytes: int | None = None,
    split_bytes: int = SPLIT_BYTES,
    registry_path: str | None = None,
) -> None:
    """Read, judge, deduplicate and store all files under ``path`` as one batch.

    ``approvals`` (path, institution, currency, date_order, approval_seq) lets layouts
    in that nobody approved before; ``requested`` (path) reports files that are
    missing; ``files`` replaces the scan, for a caller that already has the bytes;
    files over ``max_bytes`` are refused and logged, like those of another suffix. Files
    over ``split_bytes`` are read from ``path`` by ranges. What became of each acceptable
    file is in the manifest (see batch_files). ``registry_path`` adds layouts that another store
    wrote out; if some of it can't be read, every file is blocked as ``registry_invalid``.
    A batch that is published already is left alone if it is about the same files, and
    a BatchConflict if not. A failed attempt is logged in a batch of its own.
    """
    listing = list_files(spark, path) if files is None else files.select("path", "modificationTime", "length")
    content_id = files_id(listing)
    if store.committed(batch_id, content_id):
        return
    try:
        _ingest(spark, store, batch_id, as_of, approvals, requested, files, listing, max_bytes, split_bytes, registry_path, content_id)
    except Exception as error:
        store.clear(batch_id)
        record_failed_batch(store, listing, f"{batch_id}-failed-{uuid.uuid4().hex[:8]}", type(error).__name__, as_of)
        raise


def files_id(listing: DataFrame) -> str:
    """Identity of a set of files by path, time and length, in any order."""
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    found = listing.agg(F.count("*").alias("n"), F.coalesce(F.sum(mark), F.lit(0)).alias("mark")).first()
    return f"{found.n}-{found.mark}"


def known_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the listing that the manifest holds unchanged, with the import that has their rows."""
    at = ["path", "modification_time", "length"]
    stored = manifest.where("persistence_status in ('stored', 'already_imported')")
    seen = listing.withColumnRenamed("modificationTime", "modification_time").select(*at)
    return (
        stored.join(seen, at, "left_semi")
        .groupBy(*at)
        .agg(F.min(F.struct("import_id", "source_file_hash")).alias("m"))
        .select(*at, "m.*")
    )


def batch_files(store: Store, batch_id: str) -> DataFrame:
    """What became of each acceptable file of a batch: stored, already_imported or not_stored."""
    return store.read("file_manifest").where(F.col("batch_id") == batch_id)


def _paths(files: DataFrame) -> list[str]:
    # Names of files to open, which Spark's own reader keeps on the driver as well.
    return [escaped_path(r.path) for r in files.select("path").toLocalIterator()]


def _ingest(
    spark: SparkSession,
    store: Store,
    batch_id: str,
    as_of: datetime | None,
    approvals: DataFrame | None,
    requested: DataFrame | None,
    files: DataFrame | None,
    listing: DataFrame,
    max_bytes: int | None,
    split_bytes: int,
    registry_path: str | None,
    content_id: str,
) -> None:
    instant = F.lit(as_of).cast("timestamp")
    if approvals is None:
        approvals = spark.createDataFrame([], NO_APPROVALS)
    refused = refused_files(listing, requested, max_bytes)
    runs = store.read("import_runs")
    acceptable = listing.where(suffix_is_supported(F.col("path")))
    if max_bytes is not None:
        acceptable = acceptable.where(F.col("length") <= max_bytes)
    known = store.stage(known_files(acceptable, store.read("file_manifest")), batch_id, "known")
    fresh = acceptable.join(F.broadcast(known.select("path")) if is_small(known) else known.select("path"), "path", "left_anti")
    fresh = store.stage(fresh, batch_id, "fresh")
    small, large = fresh.where(F.col("length") <= split_bytes), fresh.where(F.col("length") > split_bytes)
    if files is not None:
        content = files.where(F.col("length") <= split_bytes).join(F.broadcast(small.select("path")) if is_small(small) else small.select("path"), "path", "left_semi")
    else:
        paths = _paths(small)
        content = read_files(spark, paths, split_bytes) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    parsed = store.stage(profile_files(content), batch_id, "parsed")
    file_level = parsed.drop("records")
    large_paths = _paths(large)
    large_files = large_rows = None
    if large_paths:
        if "uri" not in large.columns:
            large = large.join(list_files(spark, large_paths).select("path", "uri"), "path")
        large_files, large_rows = profile_ranges(spark, large_paths, large, lambda frame, name: store.stage(frame, batch_id, name))
        large_files = store.stage(large_files, batch_id, "large-files")
        file_level = file_level.unionByName(large_files)
    registry = store.snapshot("format_specs")
    if registry_path is not None:
        others, readable_registry = read_registry(spark, registry_path)
        registry = upsert_specs(registry, others.withColumn("issue_code", F.lit(None).cast("string")))
        if not readable_registry:
            unreadable = F.coalesce("issue_code", F.lit("registry_invalid"))
            parsed, file_level = parsed.withColumn("issue_code", unreadable), file_level.withColumn("issue_code", unreadable)
            large_files = large_files if large_files is None else large_files.withColumn("issue_code", unreadable)
    tables = list(INGEST_TABLES)
    if not is_small(approvals, 0):
        registry = store.stage(learn_approved(file_level, approvals, registry), batch_id, "registry")
        store.write("format_specs", registry, batch_id)
        tables.append("format_specs")
    specs = all_specs(spark, registry)

    import_id = keys.name_uuid(F.concat(F.lit(f"import:{batch_id}:"), "path"))
    gated = store.stage(
        examine_files(file_level, specs, approvals)
        .withColumn("import_id", import_id)
        .withColumn("import_seq", arrival_order()),
        batch_id,
        "files",
    )
    checked = store.stage(
        skip_imported(
            gated.where("ingestion_status = 'processed'"), runs, ["import_seq", "path"]
        ).select("path", "import_id", "already_imported"),
        batch_id,
        "checked",
    )
    skipped = checked.where("already_imported").select("path")
    if is_small(skipped):
        skipped = F.broadcast(skipped)
    # Files and skipped paths are unique, so the anti join cannot be skewed.
    def readable(some: DataFrame, *more: str) -> DataFrame:
        return (
            with_drift(detect_formats(some.where("issue_code is null"), specs))
            .where("selected_spec is not null and not drift_breaking")
            .join(skipped, "path", "left_anti")
            .withColumn("import_id", import_id)
            .withColumn("import_seq", arrival_order())
            .select("import_id", "import_seq", "file_id", "columns", F.col("selected_spec").alias("spec"), *more)
        )

    rows = explode_records(with_positions(readable(parsed, "records")))
    if large_rows is not None:
        of_file = with_positions(readable(large_files, "path"))
        rows = rows.unionByName(large_rows.join(F.broadcast(of_file) if is_small(of_file) else of_file, "path").drop("path"))
    candidates = store.stage(candidate_rows(rows), batch_id, "candidates")
    routed = store.stage(route_rows(candidates).withColumn("created_at", instant), batch_id, "routed")

    incoming = promote(routed.where("route = 'transaction'"))
    stored = stored_months(store, incoming)
    resolved = store.stage(
        quarantine.transactions(
            resolve_duplicates(
                incoming.withColumn("row_seq", F.col("source_location.row_number")),
                stored.withColumn("row_seq", F.col("source_location.row_number")),
            )
        ),
        batch_id,
        "resolved",
    )
    pendings = store.stage(quarantine.pendings(to_pending(routed.where("route = 'pending'"))), batch_id, "pendings")
    created = resolved.where("existing_transaction_id is null").select(*schemas.TRANSACTION_FIELDS, "violations")
    held = quarantine.held(created, "transactions", F.col("import_id")).unionByName(
        quarantine.held(pendings, "pending_transactions", F.col("import_id"))
    )
    held = store.stage(held, batch_id, "held")
    store.write("transactions", quarantine.kept(created), batch_id)
    store.write("pending_transactions", quarantine.kept(pendings), batch_id)
    store.write("quarantine", held, batch_id)
    store.write("duplicate_candidates", duplicate_rows(resolved), batch_id)
    totals = store.stage(import_totals(routed, ["import_id"]), batch_id, "totals")
    store.write(
        "import_runs", import_log(gated, checked, totals, resolved, held, refused, batch_id, instant), batch_id
    )
    store.write("file_manifest", manifest_rows(gated, checked, runs, known), batch_id)
    store.commit(batch_id, tables, content_id)


def stored_months(store: Store, incoming: DataFrame) -> DataFrame:
    """Stored transactions of the months of ``incoming``."""
    months = incoming.select(F.date_format("transaction_date", "yyyy-MM").alias("transaction_month")).distinct()
    # Calendar months are few; this prunes the stored partitions that cannot match.
    return store.read("transactions").join(F.broadcast(months), "transaction_month", "left_semi")


def duplicate_rows(resolved: DataFrame) -> DataFrame:
    return resolved.where("existing_transaction_id is not null").select(
        "import_id",
        "existing_transaction_id",
        F.col("id").alias("candidate_transaction_id"),
        "detection_strategy",
        F.col("duplicate_status").alias("status"),
        F.col("duplicate_fingerprint").alias("fingerprint"),
        F.struct(*schemas.TRANSACTION_FIELDS).alias("candidate"),
        "created_at",
    )


def manifest_rows(gated: DataFrame, checked: DataFrame, runs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per acceptable file: judged in this batch, or known from an earlier one."""
    judged = gated.join(checked.select("import_id", "already_imported"), "import_id", "left").withColumn(
        "persistence_status",
        F.when(F.col("already_imported").isNull(), F.lit("not_stored")).when(F.col("already_imported"), F.lit("already_imported")).otherwise(F.lit("stored")),
    )
    now = judged.where("persistence_status = 'stored'").select("source_file_hash", F.col("import_id").alias("holder"))
    before = runs.where("persistence_status = 'stored'").select("source_file_hash", F.col("id").alias("holder"))
    holders = now.unionByName(before).groupBy("source_file_hash").agg(F.min("holder").alias("holder"))
    columns = ["path", "modification_time", "length", "source_file_hash", "import_id", "persistence_status"]
    repeats = judged.where("persistence_status = 'already_imported'").join(holders, "source_file_hash", "left")
    rows = judged.where("persistence_status <> 'already_imported'").withColumn(
        "holder", F.when(F.col("persistence_status") == "stored", F.col("import_id"))
    ).unionByName(repeats.select(*judged.columns, "holder"))
    rows = rows.withColumn("import_id", F.col("holder")).withColumn("modification_time", F.col("modificationTime"))
    return rows.select(*columns).unionByName(known.withColumn("persistence_status", F.lit("already_imported")).select(*columns))


def import_log(
    gated: DataFrame,
    checked: DataFrame,
    totals: DataFrame,
    resolved: DataFrame,
    held: DataFrame,
    refused: DataFrame,
    batch_id: str,
    as_of: Column,
) -> DataFrame:
    """One row per attempted file. Stored counts exclude duplicates of other files; rows in quarantine count as rejected."""
    stored_files = gated.join(
        checked.where("not already_imported").select("import_id"), "import_id", "left_semi"
    )
    across = resolved.where("existing_transaction_id is not null").groupBy("import_id").agg(
        F.count(F.lit(1)).alias("duplicates_in_database")
    )
    apart = held.groupBy("import_id").agg(
        F.count_if(F.col("target") == "transactions").alias("held_transactions"),
        F.count_if(F.col("target") == "pending_transactions").alias("held_pendings"),
    )
    codes = (
        totals.select("import_id", F.explode("issue_counts").alias("code", "n"))
        .unionByName(stored_files.select("import_id", F.explode(F.transform("drift", lambda c: c["code"])).alias("code"), F.lit(1).cast("bigint").alias("n")))
        .unionByName(held.groupBy("import_id").agg(F.count(F.lit(1)).alias("n")).select("import_id", F.lit("constraint_violation").alias("code"), "n"))
        .groupBy("import_id", "code")
        .agg(F.sum("n").alias("n"))
    )
    issues = _as_map(codes, "import_id")
    zero = F.lit(0)
    done = (
        stored_files.join(totals.drop("issue_counts"), "import_id", "left")
        .join(across, "import_id", "left")
        .join(apart, "import_id", "left")
        .join(issues, "import_id", "left")
    )
    held_transactions, held_pendings = F.coalesce("held_transactions", zero), F.coalesce("held_pendings", zero)
    stored = done.select(
        F.col("import_id").alias("id"),
        "source_file_hash",
        F.col("selected_spec.institution").alias("source_institution"),
        F.col("selected_spec.format_id").alias("format_id"),
        "detection_status",
        completion_status(F.col("issue_counts").isNotNull()).alias("ingestion_status"),
        F.lit("stored").alias("persistence_status"),
        F.coalesce("records_read", zero).alias("records_read"),
        (F.coalesce("transactions_created", zero) - F.coalesce("duplicates_in_database", zero) - held_transactions).alias(
            "transactions_created"
        ),
        (F.coalesce("pending_created", zero) - held_pendings).alias("pending_created"),
        F.coalesce("duplicates_found", zero).alias("duplicates_in_file"),
        F.coalesce("duplicates_in_database", zero).alias("duplicates_in_database"),
        (F.coalesce("records_rejected", zero) + held_transactions + held_pendings).alias("records_rejected"),
        F.coalesce("issue_counts", F.create_map().cast("map<string,bigint>")).alias("issue_counts"),
    )
    blocked_codes = _as_map(blocked_issue_counts(gated), "path")
    broken_drift = F.col("gate_code") == "breaking_drift"
    blocked = gated.where("ingestion_status = 'blocked'").join(blocked_codes, "path", "left").select(
        F.col("import_id").alias("id"),
        "source_file_hash",
        F.when(broken_drift, F.col("selected_spec.institution")).alias("source_institution"),
        F.when(broken_drift, F.col("selected_spec.format_id")).alias("format_id"),
        "detection_status",
        *_not_read(),
        "issue_counts",
    )
    unopened = refused.select(
        keys.name_uuid(F.concat(F.lit(f"import:{batch_id}:"), "path")).alias("id"),
        F.lit(None).cast("string").alias("source_file_hash"),
        F.lit(None).cast("string").alias("source_institution"),
        F.lit(None).cast("string").alias("format_id"),
        F.lit("unknown").alias("detection_status"),
        *_not_read(),
        F.create_map("issue_code", F.lit(1).cast("bigint")).alias("issue_counts"),
    )
    return (
        stored.unionByName(blocked)
        .unionByName(unopened)
        .withColumn("error_code", F.lit(None).cast("string"))
        .withColumn("created_at", as_of)
    )


def _not_read() -> list[Column]:
    names = [
        "records_read",
        "transactions_created",
        "pending_created",
        "duplicates_in_file",
        "duplicates_in_database",
        "records_rejected",
    ]
    return [
        F.lit("blocked").alias("ingestion_status"),
        F.lit("not_stored").alias("persistence_status"),
        *[F.lit(0).alias(n) for n in names],
    ]


def _as_map(counted: DataFrame, key: str) -> DataFrame:
    """(key, code, n) -> one map per key; there are only a few dozen codes."""
    return counted.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("issue_counts")
    )


def record_failed_batch(store: Store, files: DataFrame, batch_id: str, error_code: str, as_of: datetime) -> None:
    """Log the attempts of a batch whose job failed, under a batch id of its own."""
    empty = {c: F.lit(None).cast(kind) for c, kind in schemas.IMPORT_RUN_FIELDS.items()}
    counts = {c: F.lit(0) for c, kind in schemas.IMPORT_RUN_FIELDS.items() if kind == "bigint"}
    row = {
        **empty,
        **counts,
        "id": keys.name_uuid(F.concat(F.lit(f"import:{batch_id}:"), "path")),
        "detection_status": F.lit("unknown"),
        "ingestion_status": F.lit("failed"),
        "persistence_status": F.lit("failed"),
        "issue_counts": F.create_map().cast("map<string,bigint>"),
        "error_code": F.lit(error_code),
        "created_at": F.lit(as_of).cast("timestamp"),
    }
    store.write("import_runs", files.select(*[row[c].alias(c) for c in schemas.IMPORT_RUN_FIELDS]), batch_id)
    store.commit(batch_id, ["import_runs"])


def summarize_store(store: Store) -> DataFrame:
    pendings = store.read("pending_transactions")
    # A closing row takes the place of the open one.
    open_ones = pendings.where("status = 'open'").join(pendings.where("status <> 'open'").select("id"), "id", "left_anti")
    return store_summary(
        store.read("import_runs"),
        store.read("transactions"),
        open_ones,
        store.read("duplicate_candidates"),
    )


def report_store(store: Store) -> DataFrame:
    return safe_report(store.read("import_runs"))
