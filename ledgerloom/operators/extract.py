"""Read canonical candidates out of the cells of a recognised layout.

One projection serves every layout: the spec travels with the row and
``parser_id`` picks the branch, so a batch may mix layouts freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import keys, values
from ledgerloom.functions.text import normalize_text, strip
from ledgerloom.sources.formats import CREDIT_DEBIT, SIGNED_TEXT

# The column that takes surplus cells, and the words of a balance line.
FOLDED_COLUMN = "historico"
BALANCE_LINE = "SALDO ANTERIOR"


def column_positions(columns: Column, mapping: Column) -> Column:
    """struct of 1-based positions; a repeated name means its last column, 0 is absent."""

    def last(name: Column) -> Column:
        from_end = F.array_position(F.reverse(columns), name)
        return F.coalesce(
            F.when((name != "") & (from_end > 0), F.size(columns) - from_end + 1), F.lit(0)
        ).cast("int")

    return F.struct(*[last(mapping[field]).alias(field) for field in schemas.MAPPED_FIELDS])


def fold_surplus(cells: Column, width: Column, at: Column) -> Column:
    """Join the surplus cells of an over-wide row into the cell at 1-based ``at``."""
    extra = F.size(cells) - width
    parts = F.filter(
        F.transform(F.slice(cells, at, extra + 1), strip), lambda part: part != ""
    )
    return F.concat(
        F.slice(cells, F.lit(1), at - 1),
        F.array(F.array_join(parts, "; ")),
        F.slice(cells, at + extra + 1, F.greatest(width - at, F.lit(0))),
    )


def with_positions(files: DataFrame) -> DataFrame:
    """Adds ``at``, worked out once per file, before its records become rows."""
    return files.withColumn("at", column_positions(F.col("columns"), F.col("spec.mapping")))


def extract_candidates(rows: DataFrame) -> DataFrame:
    """Rows (file_id, row_number, cells, columns, spec, at, ...) -> candidates.

    Adds the candidate columns, ``rejected_reason`` (the row is counted but is no
    candidate) and ``warnings`` (codes of optional values that were ignored).
    """
    spec = F.col("spec")
    signed = spec["parser_id"] == SIGNED_TEXT
    split = spec["parser_id"] == CREDIT_DEBIT
    width = F.size("columns")
    fold_at = F.array_position("columns", F.lit(FOLDED_COLUMN)).cast("int")
    folds = split & (fold_at > 0) & (F.size("cells") > width)
    prepared = rows.withColumn(
        "_cells", F.when(folds, fold_surplus(F.col("cells"), width, fold_at)).otherwise(F.col("cells"))
    )

    def cell(field: str) -> Column:
        return strip(F.coalesce(F.get("_cells", F.col("at")[field] - 1), F.lit("")))

    named = prepared.select(
        *rows.columns, "_cells", *[cell(field).alias(f"_{field}") for field in schemas.MAPPED_FIELDS]
    )
    credit, debit, amount = F.col("_credit"), F.col("_debit"), F.col("_amount")
    has_credit, has_debit = credit != "", debit != ""
    both = ~signed & has_credit & has_debit
    either = F.when(has_credit, credit).otherwise(debit)
    chosen = F.when(signed, amount).when(split | (amount == ""), either).otherwise(amount)
    parsed = named.withColumn("_chosen", chosen).withColumn(
        "_minor", F.when(~both, values.parse_money(F.col("_chosen")))
    )
    minor = F.col("_minor")
    from_text = F.coalesce(
        values.direction_from_amount_text(F.col("_chosen")),
        values.direction_from_words(F.col("_direction")),
    )
    direction = F.when(signed, from_text).when(
        minor.isNotNull(),
        F.when(has_credit, F.lit(values.INFLOW))
        .when(has_debit, F.lit(values.OUTFLOW))
        .when(~split, from_text)
        .otherwise(F.lit(values.OUTFLOW)),
    )
    date, time, balance, context = F.col("_date"), F.col("_time"), F.col("_balance_minor"), F.col("_context")
    context_text = (
        F.when(split, F.col("_description"))
        .when(F.col("_payment_method") != "", F.col("_payment_method"))
        .when(signed, F.col("_direction"))
        .otherwise(F.col("_description"))
    )
    bad_amount = both | (minor.isNull() & (signed | (F.col("_chosen") != "")))
    rejected = F.when(
        split & (credit == "") & (debit == "") & normalize_text(F.col("_description")).contains(BALANCE_LINE),
        F.lit("non_transaction_row"),
    ).when(~split & (F.size("cells") != width), F.lit("invalid_row"))
    warning = F.lit("invalid_row")
    warnings = F.array_compact(
        F.array(
            F.when(~split & (F.col("_transaction_time") != "") & time.isNull(), warning),
            F.when(~signed & (F.col("_balance") != "") & balance.isNull(), warning),
        )
    )
    # What is mentioned twice below is worked out once, in columns of its own.
    parsed = parsed.withColumns(
        {
            "_date": values.parse_date(F.col("_transaction_date"), spec["date_order"]),
            "_time": F.when(~split, values.parse_time(F.col("_transaction_time"))),
            "_balance_minor": F.when(~signed, values.parse_money(F.col("_balance"))),
            "_context": values.payment_context(context_text),
        }
    )
    external_id = F.when(~signed & (F.col("_external_id") != ""), F.col("_external_id"))
    absent = F.lit(None).cast("string")
    return parsed.select(
        *rows.columns,
        date.alias("transaction_date"),
        time.alias("transaction_time"),
        minor.alias("amount_minor"),
        direction.alias("amount_direction"),
        spec["currency"].alias("currency"),
        F.col("_description").alias("description_raw"),
        spec["institution"].alias("source_institution"),
        F.struct(
            F.col("file_id"),
            F.col("row_number").cast("int").alias("row_number"),
            F.lit(None).cast("int").alias("page_number"),
            F.lit(None).cast("int").alias("block_number"),
        ).alias("source_location"),
        keys.record_hash(F.col("cells")).alias("source_record_hash"),
        external_id.alias("external_id"),
        balance.alias("balance_minor"),
        context["method"].alias("payment_method"),
        context["instrument"].alias("payment_instrument"),
        *[
            absent.alias(name)
            for name in (
                "card_alias",
                "card_last_four",
                "source_account_ref",
                "counterparty_name",
                "merchant_name",
            )
        ],
        F.create_map().cast("map<string,string>").alias("source_metadata"),
        F.array_compact(
            F.array(
                F.when(date.isNull(), issue("invalid_transaction_date", "transaction_date")),
                F.when(bad_amount, issue("invalid_amount", "amount_minor")),
            )
        ).alias("extraction_issues"),
        rejected.alias("rejected_reason"),
        warnings.alias("warnings"),
    )


def issue(code: str, field: str, severity: str = "blocking") -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")
    )
