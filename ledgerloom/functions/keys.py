"""Hashes and identities. Deterministic, so a retried task gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import casefold, strip

UNIT_SEPARATOR = "\x1f"


def record_hash(cells: Column) -> Column:
    """SHA-256 of the raw cells as a compact JSON array.

    ``to_json`` writes rare control characters with upper-case hex digits; those
    rows alone take the branch that lowers them.
    """
    text = F.to_json(cells)
    lowered = text
    for digit in "ABCDEF":
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*+)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}"
        )
    rare = F.exists(cells, lambda cell: cell.rlike("[\x0b\x0e\x0f\x1a-\x1f]"))
    return F.sha2(F.when(rare, lowered).otherwise(text), 256)


def pack_hex(text: Column) -> Column:
    """Different bytes for different texts; lower-case hex digits take half a byte each."""
    digits = F.unhex(text)
    return F.when(F.lower(F.hex(digits)) == text, F.concat(F.unhex(F.lit("01")), digits)).otherwise(
        F.concat(F.unhex(F.lit("00")), F.encode(text, "UTF-8"))
    )


def unpack_hex(packed: Column) -> Column:
    """The text that pack_hex packed."""
    rest = F.substring(packed, F.lit(2), F.octet_length(packed))
    return F.when(F.substring(packed, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(
        F.decode(rest, "UTF-8")
    )


def name_uuid(text: Column) -> Column:
    """UUID version 5 of a text in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(text, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def is_reliable_external_id(external_id: Column) -> Column:
    clean = strip(external_id)
    return F.coalesce((clean != "") & ~clean.rlike("^0+$"), F.lit(False))


def _joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256)


def strong_key(row: dict[str, Column]) -> Column:
    """Key of a row with a usable external id, else null."""
    return F.when(
        is_reliable_external_id(row["external_id"]),
        _joined_hash(
            casefold(row["source_institution"]),
            F.coalesce(row["source_account_ref"], F.lit("")),
            row["external_id"],
            row["transaction_date"].cast("string"),
            row["amount_minor"].cast("string"),
            row["currency"],
        ),
    )


def semantic_fingerprint(row: dict[str, Column]) -> Column:
    return _joined_hash(
        casefold(row["source_institution"]),
        row["transaction_date"].cast("string"),
        row["amount_minor"].cast("string"),
        row["currency"],
        row["description_normalized"],
    )


RULE_CRITERIA = [
    "description_exact",
    "merchant_exact",
    "counterparty_exact",
    "source_institution",
    "card_alias",
]


def rule_fingerprint(row: dict[str, Column]) -> Column:
    """Identity of what a rule does; its name and on/off switch do not count.

    The hashed text is JSON with sorted fields and explicit nulls.
    """
    fields = sorted([*RULE_CRITERIA, "priority", "nature", "category_id"])
    payload = F.struct(*[row[name].alias(name) for name in fields])
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def columns_of(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names}
