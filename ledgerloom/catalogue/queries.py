"""Registered queries: every operator over whole tables, with plain result columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.catalogue import views
from ledgerloom.functions import checks, keys, text, values
from ledgerloom.operators import (
    changes,
    dedup,
    detect,
    drift,
    extract,
    gate,
    history,
    mapping,
    reports,
    reviews,
    rules,
    validate,
)
from ledgerloom.plans import classify, correct, ingest
from ledgerloom.sources import files, formats, ranges
from ledgerloom.sources.store import Store, shared_folder, stage_shared

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


def joined(array: Column | str, separator: str = ",") -> Column:
    return F.array_join(array, separator)


def codes(issues: Column | str) -> Column:
    return joined(F.transform(issues, lambda i: i["code"]))


def staged(spark: SparkSession, frame: DataFrame) -> DataFrame:
    return Store.scratch(spark).stage(frame, "query", "rows")


@query
def normalize_text(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item"), "text"
    )
    talk = views.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("item"),
        "text",
    )
    rows = docs.unionByName(talk).select("item", text.normalize_text(F.col("text")).alias("normalized"))
    return rows.withColumn("column_name", F.lower("normalized"))


@query
def generic_description(spark, sf_dir):
    rows = views.raw_rows(spark, sf_dir)
    return rows.select("seq", text.is_generic_description(F.col("description")).alias("is_generic"))


@query
def parse_money(spark, sf_dir):
    rows = views.raw_rows(spark, sf_dir)
    exact = F.concat(F.expr("cast(cents div 1000 as string)"), F.lit("."), F.lpad(F.expr("cast(cents % 1000 as string)"), 3, "0"))
    return rows.select(
        "seq",
        values.parse_money(F.col("amount_text")).alias("minor"),
        values.decimal_to_minor(exact).alias("from_decimal"),
    )


@query
def parse_dates(spark, sf_dir):
    rows = views.raw_rows(spark, sf_dir)
    return rows.select(
        "seq",
        values.parse_date(F.col("date_text")).alias("undeclared"),
        *[values.parse_date(F.col("date_text"), F.lit(o)).alias(o) for o in ("ymd", "dmy", "mdy")],
        values.parse_time(F.col("time_text")).alias("time_of_day"),
        values.bad_time(F.col("time_text")).alias("bad_time"),
    )


@query
def signed_amount(spark, sf_dir):
    rows = views.raw_rows(spark, sf_dir).select(
        "seq",
        values.parse_money(F.col("amount_text")).alias("minor"),
        F.coalesce(
            values.direction_from_amount_text(F.col("amount_text")), values.direction_from_words(F.col("words"))
        ).alias("direction"),
    )
    signed = rows.withColumn("s", values.normalize_signed_amount(F.col("minor"), F.col("direction")))
    return signed.select("seq", "direction", F.col("s.value").alias("signed"), F.col("s.code").alias("code"))


@query
def payment_context(spark, sf_dir):
    raw = views.raw_rows(spark, sf_dir).select(
        F.concat(F.lit("o"), F.col("seq").cast("string")).alias("item"),
        F.concat_ws(" ", "description", "words").alias("text"),
    )
    talk = views.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("item"),
        "text",
    )
    both = raw.unionByName(talk).withColumn("c", values.payment_context(F.col("text")))
    return both.select("item", F.col("c.method").alias("method"), F.col("c.instrument").alias("instrument"))


@query
def record_and_file_hash(spark, sf_dir):
    rows = views.raw_rows(spark, sf_dir)
    record = keys.record_hash(F.array("date_text", "amount_text", "description", "external_id"))
    return rows.select(
        "seq",
        record.alias("record_hash"),
        keys.name_uuid(record).alias("file_id"),
        keys.is_reliable_external_id(F.col("external_id")).alias("reliable"),
    )


@query
def dedup_keys(spark, sf_dir):
    return views.event_transactions(spark, sf_dir).select("id", "strong_dedup_key", "semantic_fingerprint")


@query
def rule_fingerprints(spark, sf_dir):
    rows = views.part_rules(spark, sf_dir)
    names = keys.columns_of(*rows.columns)
    return rows.select(
        "id",
        keys.rule_fingerprint(names).alias("fingerprint"),
        joined(checks.rule_violations()).alias("violations"),
        text.slug(F.col("name")).alias("slug"),
    )


@query
def split_records(spark, sf_dir):
    profiled = files.profile_files(views.statement_files(spark, sf_dir))
    rows = files.explode_records(profiled.select("path", "encoding", "records"))
    return rows.select("path", "encoding", "row_number", F.size("cells").alias("width"), joined("cells", "~").alias("cells"))


@query
def profile_files(spark, sf_dir):
    profiled = files.profile_files(views.statement_files(spark, sf_dir))
    return profiled.select(
        "path",
        "encoding",
        "delimiter",
        "header_row_number",
        joined("columns").alias("columns"),
        "row_count",
        "irregular_row_count",
        "signature",
        "source_file_hash",
        "issue_code",
    )


@query
def read_ranges(spark, sf_dir):
    """Records of real files that are read by byte ranges, whatever their size."""
    folder = f"{shared_folder(spark)}/large-{uuid.uuid4().hex}"
    views.large_files(spark, sf_dir, folder)
    listing = files.list_files(spark, folder)
    profiles, records = ranges.profile_ranges(spark, folder, listing, stage_shared)
    of_file = profiles.select("path", "delimiter", joined("columns").alias("columns"), "row_count")
    number = F.regexp_extract("path", "file_no=([0-9]+)", 1).cast("bigint")
    return records.join(of_file, "path").select(
        number.alias("file_no"), "delimiter", "columns", "row_count", "row_number", F.size("cells").alias("width"), joined("cells", "~").alias("cells")
    )


@query
def suggest_mapping(spark, sf_dir):
    rows = mapping.suggest_mapping(views.layout_profiles(spark, sf_dir))
    picked = [F.col(f"suggested_mapping.{f}").alias(f) for f in schemas.MAPPED_FIELDS]
    return rows.select("p_partkey", *picked, "mapping_confidence", joined("missing_fields").alias("missing_fields"))


def _known_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in specs and one learned layout per nation."""
    empty = F.lit(None).cast("string")
    wanted = {"transaction_date": "data", "description": "memo", "amount": "valor"}
    pair = F.struct(*[F.lit(wanted.get(f)).cast("string").alias(f) for f in schemas.MAPPED_FIELDS])
    learned = views.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("learned_csv_"), F.lower("n_name")).alias("format_id"),
        F.col("n_name").alias("institution"),
        F.lit(formats.CONFIGURABLE).alias("parser_id"),
        F.lit("BRL").alias("currency"),
        empty.alias("date_order"),
        views.choose(F.col("n_nationkey") % 4, [",", ";", "\t", "|"]).alias("delimiter"),
        F.array(
            F.lit("data"),
            F.lit("memo"),
            F.lit("valor"),
            *[views.choose(F.col("n_nationkey") % 5, options) for options in (["docto", "tipo", "hora", "saldo", "credito"], ["debito", "saldo", "forma de pagamento", "credito", "historico"])],
        ).alias("expected_columns"),
        F.array(F.lit("data"), F.lit("memo")).alias("required_columns"),
        F.array(F.array(F.lit("valor"))).alias("required_any_groups"),
        pair.alias("mapping"),
        F.lit(True).alias("learned"),
        F.col("n_nationkey").cast("bigint").alias("spec_order"),
    )
    return formats.all_specs(spark, learned)


def _listed(detected: DataFrame) -> DataFrame:
    return detected.select(
        "p_partkey",
        "detection_status",
        F.col("selected_spec.format_id").alias("format_id"),
        joined(
            F.transform("format_candidates", lambda c: F.concat(c["format_id"], F.lit(":"), F.round(c["confidence"] * 10000).cast("bigint").cast("string")))
        ).alias("candidates"),
    )


@query
def detect_formats(spark, sf_dir):
    return _listed(detect.detect_formats(views.layout_profiles(spark, sf_dir), _known_specs(spark, sf_dir)))


@query
def detect_formats_large_registry(spark, sf_dir):
    profiles, specs = views.layout_profiles(spark, sf_dir), _known_specs(spark, sf_dir)
    return _listed(detect.detect_formats(profiles, specs, inline_max=0))


@query
def learn_formats(spark, sf_dir):
    profiles = mapping.suggest_mapping(views.layout_profiles(spark, sf_dir))
    size = F.col("p_size")
    approved = profiles.withColumns(
        {
            "mapping": F.col("suggested_mapping"),
            "institution": F.when(size == 7, F.lit(" ")).when(size == 8, F.lit("a\tb")).otherwise(F.concat(F.lit(" Banco São "), size.cast("string"))),
            "currency": F.when(size == 9, F.lit("R$")).otherwise(F.lit("brl")),
            "date_order": views.choose(size % 4, ["ymd", "dmy", "mdy", "xyz"]),
            "approval_seq": F.col("p_partkey"),
        }
    )
    learned = formats.learn_specs(approved)
    registry = formats.upsert_specs(formats.builtin_specs(spark), learned)
    refused = learned.where("issue_code is not null").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("refused").alias("format_id"),
        F.lit(None).cast("string").alias("institution"),
        F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("date_order"),
        F.lit(None).cast("string").alias("delimiter"),
        F.lit(None).cast("string").alias("required"),
        F.lit(None).cast("string").alias("any_group"),
        F.col("n").alias("spec_order"),
    )
    return registry.select(
        "format_id",
        "institution",
        "currency",
        "date_order",
        "delimiter",
        joined("required_columns").alias("required"),
        joined(F.get("required_any_groups", F.lit(0))).alias("any_group"),
        "spec_order",
    ).unionByName(refused)


def _with_fixed_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile with the built-in spec it was derived from."""
    specs = formats.builtin_specs(spark).select(
        (F.col("spec_order")).alias("origin"), formats.spec_struct().alias("selected_spec")
    )
    profiles = views.layout_profiles(spark, sf_dir).withColumn("origin", F.col("p_partkey") % 2)
    return profiles.join(F.broadcast(specs), "origin")


@query
def schema_drift(spark, sf_dir):
    rows = drift.with_drift(_with_fixed_spec(spark, sf_dir))
    shown = F.transform(
        "drift", lambda c: F.concat_ws(":", c["code"], c["severity"], F.array_join(c["fields"], "+"))
    )
    return rows.select("p_partkey", joined(shown, "|").alias("changes"), "drift_breaking")


@query
def gate_files(spark, sf_dir):
    detected = drift.with_drift(detect.detect_formats(views.layout_profiles(spark, sf_dir), formats.builtin_specs(spark)))
    size = F.col("p_size")
    asked = detected.withColumns(
        {
            "issue_code": F.when(size == 50, F.lit("unreadable_file")),
            "approval_institution": F.when(size % 3 > 0, F.lit("Banco")),
            "approval_currency": F.when(size % 3 > 1, F.lit("BRL")),
            "approval_error": F.when(size % 5 == 0, F.lit("registry_invalid")),
        }
    )
    return gate.gate_files(asked).select("p_partkey", "detection_status", "ingestion_status", "gate_code")


def _parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the derived files with the spec that reads them."""
    profiled = files.profile_files(views.statement_files(spark, sf_dir))
    layout = F.substring("path", 6, 12).cast("bigint") % 5
    known = formats.builtin_specs(spark).select(F.col("spec_order").alias("layout"), formats.spec_struct().alias("spec"))
    suggested = mapping.suggest_mapping(profiled).withColumn("layout", layout)
    with_known = suggested.join(F.broadcast(known), "layout", "left")
    generic = F.struct(
        F.lit("approved").alias("format_id"),
        F.lit("Approved").alias("institution"),
        F.lit(formats.CONFIGURABLE).alias("parser_id"),
        F.lit("EUR").alias("currency"),
        F.when(F.col("layout") == 2, F.lit("dmy")).alias("date_order"),
        F.col("delimiter").alias("delimiter"),
        F.col("columns").alias("expected_columns"),
        F.array("suggested_mapping.transaction_date").alias("required_columns"),
        F.array(F.array("suggested_mapping.amount")).alias("required_any_groups"),
        F.col("suggested_mapping").alias("mapping"),
        F.lit(True).alias("learned"),
        F.lit(2).cast("bigint").alias("spec_order"),
    ).cast("struct<" + ",".join(f"{k}:{v}" for k, v in schemas.SPEC_FIELDS.items()) + ">")
    chosen = with_known.select("path", "file_id", "columns", F.coalesce("spec", generic).alias("spec"), "records")
    return files.explode_records(extract.with_positions(chosen))


@query
def extract_candidates(spark, sf_dir):
    return extract.extract_candidates(_parsed_rows(spark, sf_dir)).select(
        "path",
        "row_number",
        "transaction_date",
        "transaction_time",
        "amount_minor",
        "amount_direction",
        "currency",
        "description_raw",
        "source_institution",
        "external_id",
        "balance_minor",
        "payment_method",
        codes("extraction_issues").alias("issues"),
        "rejected_reason",
    )


@query
def validate_candidates(spark, sf_dir):
    rows = validate.validate_candidates(views.candidates(spark, sf_dir))
    return rows.select(
        F.col("row_number").alias("seq"), "amount_signed", "description_normalized", codes("issues").alias("issues"), "outcome"
    )


@query
def constraint_violations(spark, sf_dir):
    rows = validate.validate_candidates(views.candidates(spark, sf_dir))
    promoted = rows.withColumn("amount_minor", F.col("amount_signed"))
    return promoted.select(
        F.col("row_number").alias("seq"), joined(checks.transaction_violations()).alias("violations")
    )


def _pendings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked rows, written as the pending table of a store would be."""
    valid = validate.validate_candidates(staged(spark, views.candidates(spark, sf_dir)))
    return staged(spark, validate.to_pending(valid.where("outcome = 'pending'")))


@query
def apply_corrections(spark, sf_dir):
    pendings = _pendings(spark, sf_dir)
    seq = F.col("candidate.source_location.row_number").cast("bigint")
    fixes = pendings.select(
        F.col("id").alias("pending_id"),
        F.when(seq % 2 == 0, F.lit("2026-02-03").cast("date")).alias("new_transaction_date"),
        F.when(seq % 3 == 0, seq * 10 + 5).alias("new_amount_minor"),
        F.when(seq % 5 == 0, F.lit("inflow")).alias("new_amount_direction"),
        F.when(seq % 4 == 0, F.lit("Padaria São João")).alias("new_description_raw"),
    )
    return validate.apply_corrections(pendings, fixes).select(
        F.col("source_location.row_number").cast("bigint").alias("seq"),
        "amount_signed",
        codes("issues").alias("issues"),
        "outcome",
        "correction_error",
    )


@query
def in_file_duplicates(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_id"),
        keys.record_hash(F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"))).alias("source_record_hash"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"),
    )
    return dedup.mark_in_file_duplicates(rows)


@query
def skip_imported(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    arriving = orders.select(
        F.col("o_orderkey").alias("file_no"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("source_file_hash"),
    )
    runs = views.table(spark, sf_dir, "customer").select(
        F.sha2(F.col("c_custkey").cast("string"), 256).alias("source_file_hash"),
        F.when(F.col("c_acctbal") > 0, F.lit("stored")).otherwise(F.lit("not_stored")).alias("persistence_status"),
    )
    return dedup.skip_imported(arriving, runs, ["file_no"])


@query
def cross_file_duplicates(spark, sf_dir):
    """Imports 0 to 3 arrive first and are stored; the others are compared with them."""
    rows = views.event_transactions(spark, sf_dir)
    first = dedup.resolve_duplicates(rows.where("import_seq < 4"))
    # The stored half is written, as a store would hold it.
    first = staged(spark, first)
    kept = first.where("existing_transaction_id is null").select(*rows.columns)
    second = dedup.resolve_duplicates(rows.where("import_seq >= 4"), kept)
    return first.unionByName(second).select(
        "id", "existing_transaction_id", "detection_strategy", "duplicate_status"
    )


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.route_rows(staged(spark, views.candidates(spark, sf_dir)))


@query
def import_summary(spark, sf_dir):
    return reports.import_totals(_routed(spark, sf_dir), ["import_id"]).select(
        "import_id",
        "records_read",
        "transactions_created",
        "pending_created",
        "duplicates_found",
        "records_rejected",
        "balanced",
        F.to_json("issue_counts").alias("issue_counts"),
        reports.completion_status(F.col("rows_with_issues") > 0).alias("status"),
    )


@query
def store_batch(spark, sf_dir):
    """The whole batch: derived files in, stored tables out, imported twice."""
    store = Store.scratch(spark)
    arriving = staged(spark, views.statement_files(spark, sf_dir))
    for batch in ("first", "second"):
        ingest.ingest_batch(spark, store, "", batch, datetime(2026, 1, 2), files=arriving)
    return ingest.summarize_store(store)


@query
def active_rules(spark, sf_dir):
    categories = views.part_categories(spark, sf_dir)
    usable = rules.usable_rules(views.part_rules(spark, sf_dir), categories)
    return reports.list_rules(usable).select("id", "priority", "category_name")


@query
def match_rules(spark, sf_dir):
    usable = rules.usable_rules(views.part_rules(spark, sf_dir), views.part_categories(spark, sf_dir))
    return _proposals(rules.propose(views.order_transactions(spark, sf_dir), usable, _evidence))


def _evidence(rule_ids: Column) -> dict[str, Column]:
    return {"matched_rules": F.size(rule_ids), "evidence": F.sha2(joined(rule_ids), 256)}


def _proposals(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        "status",
        "nature",
        F.col("proposed_category_id").alias("category_id"),
        "winning_rule_id",
        "matched_rules",
        "evidence",
        "review_reason",
    )


@query
def classify_undecided(spark, sf_dir):
    proposals = classify.classify_undecided(
        views.order_transactions(spark, sf_dir),
        views.event_decisions(spark, sf_dir),
        views.part_rules(spark, sf_dir),
        views.part_categories(spark, sf_dir),
    )
    decided = history.current_decisions(views.event_decisions(spark, sf_dir))
    return reports.run_summary(proposals, decided)


@query
def undecided_queue(spark, sf_dir):
    """The first 500 undecided transactions, oldest first."""
    waiting = rules.undecided(
        views.order_transactions(spark, sf_dir), history.current_decisions(views.event_decisions(spark, sf_dir))
    )
    return reports.list_undecided(waiting).select("id", "transaction_date")


@query
def decision_history(spark, sf_dir):
    categories = views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("event_type").alias("id"), F.initcap("event_type").alias("name")
    )
    rows = history.decision_history(views.event_decisions(spark, sf_dir), categories)
    return rows.select("id", "transaction_id", "category_name", "decided_at", "superseded_at", "is_current")


@query
def current_decision_for(spark, sf_dir):
    """Current decisions of the transactions whose user ever signed up above the mean value."""
    events = views.table(spark, sf_dir, "events")
    wanted = events.where("event_type = 'signup' and value > 30").select(F.col("user_id").cast("string").alias("transaction_id"))
    current = history.current_decisions(views.event_decisions(spark, sf_dir))
    return history.rows_for(current, "transaction_id", wanted).select("id", "transaction_id", "category_id")


@query
def review_queue(spark, sf_dir):
    rows = reviews.reviews(views.event_reviews(spark, sf_dir))
    return rows.select(
        "transaction_id",
        "episode",
        "status",
        "reason",
        joined("candidate_rule_ids").alias("candidate_rule_ids"),
        F.size("candidate_rule_ids").alias("candidate_rules"),
        "created_at",
        "resolved_at",
    )


@query
def open_review_queue(spark, sf_dir):
    rows = reports.redacted_reviews(reviews.open_reviews(views.event_reviews(spark, sf_dir)))
    return reports.list_open_reviews(rows).select("transaction_id", "reason", "candidate_rules", "created_at")


@query
def apply_category_changes(spark, sf_dir):
    name = F.concat(F.lit("Catégoria "), (F.col("user_id") % 40).cast("string"))
    log = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        views.choose(
            F.expr("case event_type when 'click' then 0 when 'view' then 0 when 'error' then 1 when 'purchase' then 2 else 3 end"),
            ["create", "activate", "deactivate", "create"],
        ).alias("action"),
        F.when(F.col("event_type") == "signup", F.lit(" - ")).otherwise(name).alias("name"),
        keys.name_uuid(F.concat(F.lit("category:"), text.normalize_text(name))).alias("id"),
    )
    none = spark.createDataFrame([], schemas.ddl(schemas.CATEGORY_FIELDS))
    after, results = changes.apply_category_changes(none, log)
    refused = results.where("not applied").agg(F.count(F.lit(1)).alias("n"))
    return after.select("normalized_name", "is_active", "created_seq").unionByName(
        refused.select(F.lit("refused").alias("normalized_name"), F.lit(False).alias("is_active"), F.col("n").alias("created_seq"))
    )


@query
def apply_rule_changes(spark, sf_dir):
    """One create per part over an empty rule table; equal fingerprints are one rule."""
    log = views.part_rules(spark, sf_dir).select(
        F.col("created_seq").alias("seq"),
        F.lit("create").alias("action"),
        F.lit(None).cast("string").alias("id"),
        F.concat(F.lit("Rule "), "name").alias("name"),
        # A coarse priority makes many parts describe the same rule.
        (F.floor(F.col("priority") / 250) * 250).cast("int").alias("priority"),
        "nature",
        "category_id",
        *keys.RULE_CRITERIA,
        "created_by_user",
    )
    none = spark.createDataFrame([], schemas.ddl(schemas.RULE_FIELDS))
    after, results = changes.apply_rule_changes(none, log, views.part_categories(spark, sf_dir))
    refused = results.where("not applied").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))
    return after.select("rule_fingerprint", "name", "is_enabled", "created_seq").unionByName(
        refused.select(
            F.col("error_code").alias("rule_fingerprint"),
            F.lit("refused").alias("name"),
            F.lit(False).alias("is_enabled"),
            F.col("n").alias("created_seq"),
        )
    )


def _correction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    names = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return (
        views.table(spark, sf_dir, "events")
        .withColumn("k", F.expr("cast(event_id % 30 as int)"))
        .join(F.broadcast(names), "k", "left")
        .select(
            event.alias("seq"),
            F.when(event % 17 == 0, F.concat(F.lit("missing-"), event.cast("string")))
            .otherwise(F.col("user_id").cast("string"))
            .alias("transaction_id"),
            views.choose(event % 4, ["despesa", "receita", "transferencia_interna", "estorno"]).alias("nature"),
            F.lower("n_name").alias("category_name"),
            (F.col("event_type") == "purchase").alias("remember"),
            (F.lit(1) + event % 1100).alias("rule_priority"),
            F.col("ts").alias("requested_at"),
        )
    )


def _corrected(spark: SparkSession, sf_dir: str) -> correct.Corrections:
    none = spark.createDataFrame([], schemas.ddl(schemas.RULE_FIELDS))
    earlier = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("old-"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_custkey").cast("string").alias("transaction_id"),
        F.lit("estorno").alias("nature"),
        F.lit(None).cast("string").alias("category_id"),
        F.lit("rule").alias("source"),
        F.lit("r").alias("rule_id"),
        F.array(F.lit("r")).alias("matched_rule_ids"),
        F.lit("highest_priority_rule").alias("reason_code"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("decided_at"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    return correct.correct_classifications(
        _correction_requests(spark, sf_dir),
        views.order_transactions(spark, sf_dir),
        views.nation_categories(spark, sf_dir),
        none,
        earlier,
    )


@query
def correct_classification(spark, sf_dir):
    """Audit rows: which request replaced which decision, and whether it was remembered."""
    result = _corrected(spark, sf_dir)
    made = result.decisions.select("id", "seq", "nature", "category_id")
    previous = made.select(F.col("id").alias("previous_decision_id"), F.col("seq").alias("previous_seq"))
    audit = result.corrections.join(
        made.withColumnRenamed("id", "new_decision_id"), "new_decision_id"
    ).join(previous, "previous_decision_id", "left")
    return audit.select(
        "seq",
        "transaction_id",
        "nature",
        "category_id",
        F.coalesce("previous_seq", F.when(F.col("previous_decision_id").isNotNull(), F.lit(-1))).alias("previous_seq"),
        F.col("remembered_rule_id").isNotNull().alias("remembered"),
    )


@query
def correction_errors(spark, sf_dir):
    checked = correct.check_requests(
        _correction_requests(spark, sf_dir), views.order_transactions(spark, sf_dir), views.nation_categories(spark, sf_dir)
    )
    return checked.groupBy(F.coalesce("error_code", F.lit("accepted")).alias("result")).agg(
        F.count(F.lit(1)).alias("requests")
    )


@query
def classification_overview(spark, sf_dir):
    """Counts over categories, rules, current decisions, open reviews and corrections."""
    return reports.classification_summary(
        views.part_categories(spark, sf_dir),
        views.part_rules(spark, sf_dir),
        views.event_decisions(spark, sf_dir),
        views.event_reviews(spark, sf_dir),
        views.table(spark, sf_dir, "events").where("event_type = 'purchase'"),
    )


@query
def check_proposals(spark, sf_dir):
    """Each order proposed with the rule of the part of the same number."""
    usable = rules.usable_rules(views.part_rules(spark, sf_dir), views.part_categories(spark, sf_dir))
    orders = views.table(spark, sf_dir, "orders")
    rule = views.part_rules(spark, sf_dir).select(F.col("created_seq").alias("o_custkey"), "nature", "category_id", F.col("id").alias("winning_rule_id"))
    proposals = orders.join(rule, "o_custkey").select(
        F.when(F.col("o_orderkey") % 19 == 0, F.lit("missing")).otherwise(F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("estorno")).otherwise(F.col("nature")).alias("nature"),
        "category_id",
        "winning_rule_id",
    )
    checked = rules.proposal_errors(proposals, views.order_transactions(spark, sf_dir), usable)
    return checked.groupBy(F.coalesce("error_code", F.lit("accepted")).alias("result")).agg(
        F.count(F.lit(1)).alias("proposals")
    )


@query
def pending_queue(spark, sf_dir):
    """The first 100 open pendings; equal times are listed by source row."""
    rows = _pendings(spark, sf_dir).select(
        F.lpad(F.col("candidate.source_location.row_number").cast("string"), 12, "0").alias("id"),
        "status",
        "created_at",
        codes("issues").alias("issues"),
    )
    return reports.list_open_pending(rows).select("id", "issues")


@query
def classifier_view(spark, sf_dir):
    return reports.classifier_view(views.order_transactions(spark, sf_dir))


@query
def redacted_rule_list(spark, sf_dir):
    named = rules.with_category(views.part_rules(spark, sf_dir), views.part_categories(spark, sf_dir))
    return reports.redacted_rules(named)


@query
def category_list(spark, sf_dir):
    return reports.list_categories(views.part_categories(spark, sf_dir), active_only=True).select("id", "name")


@query
def outcomes_by_institution(spark, sf_dir):
    """Flagship: rows of every institution by outcome, with the signed total."""
    valid = validate.validate_candidates(views.candidates(spark, sf_dir))
    return valid.groupBy("source_institution", "outcome").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount_signed").alias("total_minor")
    )
