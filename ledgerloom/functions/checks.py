"""Row constraints as arrays of broken rules; empty means the row may be stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.keys import RULE_CRITERIA

SHA256_HEX = "^[0-9a-f]{64}$"
CURRENCY = "^[A-Z]{3}$"


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition is not true (null counts as broken)."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def _optional(column: str, ok: Column) -> Column:
    return F.col(column).isNull() | ok


def _source_rules() -> dict[str, Column]:
    location = F.col("source_location")
    return {
        "currency_format": F.col("currency").rlike(CURRENCY),
        "institution_present": F.length("source_institution") > 0,
        "record_hash_format": F.col("source_record_hash").rlike(SHA256_HEX),
        "card_last_four_format": _optional("card_last_four", F.col("card_last_four").rlike(r"^\d{4}$")),
        "payment_method_known": _optional("payment_method", F.col("payment_method").isin(*schemas.PAYMENT_METHODS)),
        "payment_instrument_known": _optional(
            "payment_instrument", F.col("payment_instrument").isin(*schemas.PAYMENT_INSTRUMENTS)
        ),
        "location_positive": location["file_id"].isNotNull()
        & F.coalesce(location["row_number"] >= 1, F.lit(True))
        & F.coalesce(location["page_number"] >= 1, F.lit(True))
        & F.coalesce(location["block_number"] >= 1, F.lit(True)),
    }


def candidate_violations() -> Column:
    return _broken(
        {
            **_source_rules(),
            "direction_known": _optional("amount_direction", F.col("amount_direction").isin(*schemas.DIRECTIONS)),
        }
    )


def transaction_violations() -> Column:
    return _broken(
        {
            **_source_rules(),
            "date_present": F.col("transaction_date").isNotNull(),
            "amount_not_zero": F.col("amount_minor") != 0,
            "description_present": F.length("description_raw") > 0,
            "normalized_description_present": F.length("description_normalized") > 0,
        }
    )


def pending_violations() -> Column:
    return _broken(
        {
            "blocking_issue_present": F.exists("issues", lambda i: i["severity"] == "blocking"),
            "open_not_resolved": (F.col("status") != "open") | F.col("resolved_at").isNull(),
        }
    )


def rule_violations() -> Column:
    """On normalised rules; an empty criterion does not count as a criterion."""
    needs_category = F.col("nature").isin(*schemas.NATURES_WITH_CATEGORY)
    usable = F.lit(False)
    for name in RULE_CRITERIA:
        usable = usable | F.coalesce(F.col(name) != "", F.lit(False))
    return _broken(
        {
            "name_length": F.length("name").between(1, 120),
            "priority_range": F.col("priority").between(1, 1000),
            "nature_known": F.col("nature").isin(*schemas.NATURES),
            "criterion_present": usable,
            "category_required": ~needs_category | F.col("category_id").isNotNull(),
        }
    )


def decision_violations() -> Column:
    needs_category = F.col("nature").isin(*schemas.NATURES_WITH_CATEGORY)
    return _broken(
        {
            "nature_known": F.col("nature").isin(*schemas.NATURES),
            "category_required": ~needs_category | F.col("category_id").isNotNull(),
            "rule_source_names_rule": (F.col("source") != "rule") | F.col("rule_id").isNotNull(),
            "user_source_without_rule": (F.col("source") != "user") | F.col("rule_id").isNull(),
        }
    )
