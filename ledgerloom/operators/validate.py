"""Turn tolerant candidates into transactions or pendings, and apply corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys
from ledgerloom.functions.text import normalize_text, words_are_generic
from ledgerloom.functions.values import normalize_signed_amount
from ledgerloom.operators.extract import issue

DATE_CODES = ["missing_transaction_date", "invalid_transaction_date"]
DIRECTION_CODES = ["ambiguous_amount_direction", "conflicting_amount_direction"]
AMOUNT_CODES = ["missing_amount", "invalid_amount", "zero_amount", *DIRECTION_CODES]
DESCRIPTION_CODES = ["missing_description", "generic_description_only"]

# Which extraction issues a corrected field answers.
CLEARED_BY = {
    "transaction_date": DATE_CODES,
    "amount_minor": AMOUNT_CODES,
    "amount_direction": DIRECTION_CODES,
    "description_raw": DESCRIPTION_CODES,
}


def _has_any(issues: Column, codes: list[str]) -> Column:
    return F.exists(issues, lambda i: i["code"].isin(*codes))


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """Adds amount_signed, description_normalized, issues and outcome.

    Outcome is ``pending`` when any issue blocks, else ``transaction``. Issues keep
    the order extraction, date, amount, description.
    """
    found = F.coalesce(F.col("extraction_issues"), F.array().cast(f"array<{schemas.ISSUE}>"))
    prepared = (
        candidates.withColumn("_found", found)
        .withColumn(
            "_signed", normalize_signed_amount(F.col("amount_minor"), F.col("amount_direction"))
        )
        .withColumn(
            "description_normalized", normalize_text(F.coalesce(F.col("description_raw"), F.lit("")))
        )
    )
    text = F.col("description_normalized")
    code = F.col("_signed.code")
    date_issue = F.when(
        F.col("transaction_date").isNull() & ~_has_any(F.col("_found"), DATE_CODES),
        issue("missing_transaction_date", "transaction_date"),
    )
    amount_issue = F.when(
        F.col("amount_minor").isNull() & ~_has_any(F.col("_found"), ["missing_amount", "invalid_amount"]),
        issue("missing_amount", "amount_minor"),
    ).when(
        code.isNotNull(),
        F.struct(code.alias("code"), F.lit("amount_minor").alias("field"), F.lit("blocking").alias("severity")),
    )
    text_issue = F.when(
        text == "",
        F.when(
            ~_has_any(F.col("_found"), ["missing_description"]),
            issue("missing_description", "description_raw"),
        ),
    ).when(words_are_generic(text), issue("generic_description_only", "description_raw"))
    issues = F.concat(F.col("_found"), F.array_compact(F.array(date_issue, amount_issue, text_issue)))
    kept = [c for c in candidates.columns if c != "description_normalized"]
    return prepared.select(
        *kept,
        F.col("_signed.value").alias("amount_signed"),
        "description_normalized",
        issues.alias("issues"),
    ).withColumn(
        "outcome",
        F.when(F.exists("issues", lambda i: i["severity"] == "blocking"), F.lit("pending")).otherwise(
            F.lit("transaction")
        ),
    )


def promote(valid: DataFrame) -> DataFrame:
    """Valid rows -> canonical transactions with keys; ids repeat on a retry."""
    signed = valid.withColumn("amount_minor", F.col("amount_signed"))
    names = keys.columns_of(*signed.columns)
    identity = F.concat_ws(
        ":", F.lit("transaction"), "import_id", F.col("source_location.row_number").cast("string")
    )
    columns = {
        "id": keys.name_uuid(identity),
        "strong_dedup_key": keys.strong_key(names),
        "semantic_fingerprint": keys.semantic_fingerprint(names),
    }
    return signed.select(
        *[columns.get(c, F.col(c)).cast(kind).alias(c) for c, kind in schemas.TRANSACTION_FIELDS.items()]
    )


def candidate_struct() -> Column:
    return F.struct(*schemas.CANDIDATE_FIELDS).cast(schemas.CANDIDATE)


def to_pending(blocked: DataFrame) -> DataFrame:
    identity = F.concat_ws(
        ":", F.lit("pending"), "import_id", F.col("source_location.row_number").cast("string")
    )
    return blocked.select(
        keys.name_uuid(identity).alias("id"),
        "import_id",
        F.lit("open").alias("status"),
        "issues",
        candidate_struct().alias("candidate"),
        "created_at",
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


CORRECTABLE = list(CLEARED_BY)


def correction_error(pending_status: Column) -> Column:
    """Why a correction row (already joined to its pending) cannot be applied."""
    empty = F.coalesce(*[F.col(f"new_{f}").cast("string") for f in CORRECTABLE]).isNull()
    return (
        F.when(pending_status.isNull(), F.lit("pending_not_found"))
        .when(pending_status != "open", F.lit("pending_not_open"))
        .when(empty, F.lit("empty_correction"))
    )


def apply_corrections(pendings: DataFrame, corrections: DataFrame) -> DataFrame:
    """Revalidated candidates of the corrected open pendings.

    ``corrections`` has one row per pending_id with the nullable new_<field>
    columns. The result carries pending_id, correction_error, and for accepted
    rows the columns of :func:`validate_candidates`; a row that is still blocked has
    outcome ``pending``.
    """
    joined = corrections.join(
        pendings.select(
            F.col("id").alias("pending_id"), "import_id", "status", "candidate", "created_at"
        ),
        "pending_id",
        "left",
    ).withColumn("correction_error", correction_error(F.col("status")))
    cleared = F.flatten(
        F.array(
            *[
                F.when(F.col(f"new_{field}").isNotNull(), F.array(*[F.lit(c) for c in codes])).otherwise(
                    F.array().cast("array<string>")
                )
                for field, codes in CLEARED_BY.items()
            ]
        )
    )
    updates = {
        **{f: F.coalesce(F.col(f"new_{f}"), F.col(f"candidate.{f}")) for f in CORRECTABLE},
        "extraction_issues": F.filter(
            "candidate.extraction_issues", lambda i: ~F.array_contains(cleared, i["code"])
        ),
    }
    return validate_candidates(
        joined.select(
            "pending_id",
            "import_id",
            "created_at",
            "correction_error",
            *[updates.get(f, F.col(f"candidate.{f}")).alias(f) for f in schemas.CANDIDATE_FIELDS],
        )
    ).withColumn("outcome", F.when(F.col("correction_error").isNull(), F.col("outcome")))


def close_corrected(pendings: DataFrame, corrected: DataFrame, as_of: Column) -> DataFrame:
    """Pendings after promotion: those whose correction became a transaction are closed."""
    done = corrected.where("outcome = 'transaction'").select(F.col("pending_id").alias("id"), F.lit(True).alias("_done"))
    return (
        pendings.join(done, "id", "left")
        .withColumn("status", F.when(F.col("_done"), F.lit("corrected")).otherwise(F.col("status")))
        .withColumn("resolved_at", F.when(F.col("_done"), as_of).otherwise(F.col("resolved_at")))
        .drop("_done")
    )
