"""Shapes shared by the jobs: canonical rows, stored tables and vocabularies."""

from __future__ import annotations

MAPPED_FIELDS = [
    "transaction_date",
    "description",
    "amount",
    "direction",
    "transaction_time",
    "credit",
    "debit",
    "balance",
    "external_id",
    "payment_method",
]

MAPPING = "struct<" + ",".join(f"{name}:string" for name in MAPPED_FIELDS) + ">"
ISSUE = "struct<code:string,field:string,severity:string>"
LOCATION = "struct<file_id:string,row_number:int,page_number:int,block_number:int>"

SPEC_FIELDS = {
    "format_id": "string",
    "institution": "string",
    "parser_id": "string",
    "currency": "string",
    "date_order": "string",
    "delimiter": "string",
    "expected_columns": "array<string>",
    "required_columns": "array<string>",
    "required_any_groups": "array<array<string>>",
    "mapping": MAPPING,
    "learned": "boolean",
    "spec_order": "bigint",
}

# What a parser leaves behind for one source row, before validation.
CANDIDATE_FIELDS = {
    "transaction_date": "date",
    "transaction_time": "string",
    "amount_minor": "bigint",
    "amount_direction": "string",
    "currency": "string",
    "description_raw": "string",
    "source_institution": "string",
    "source_location": LOCATION,
    "source_record_hash": "string",
    "external_id": "string",
    "balance_minor": "bigint",
    "payment_method": "string",
    "payment_instrument": "string",
    "card_alias": "string",
    "card_last_four": "string",
    "source_account_ref": "string",
    "counterparty_name": "string",
    "merchant_name": "string",
    "source_metadata": "map<string,string>",
    "extraction_issues": f"array<{ISSUE}>",
}

CANDIDATE = "struct<" + ",".join(f"{k}:{v}" for k, v in CANDIDATE_FIELDS.items()) + ">"

# A candidate that became a transaction loses its direction (the sign holds it) and
# its issues, and gains identity, normalised text and the deduplication keys.
TRANSACTION_FIELDS = {
    "id": "string",
    "import_id": "string",
    **{
        name: kind
        for name, kind in CANDIDATE_FIELDS.items()
        if name not in ("amount_direction", "extraction_issues")
    },
    "description_normalized": "string",
    "strong_dedup_key": "string",
    "semantic_fingerprint": "string",
    "import_seq": "string",
    "created_at": "timestamp",
}

CATEGORY_FIELDS = {
    "id": "string",
    "name": "string",
    "normalized_name": "string",
    "is_active": "boolean",
    "created_seq": "bigint",
}

RULE_FIELDS = {
    "id": "string",
    "name": "string",
    "priority": "int",
    "nature": "string",
    "category_id": "string",
    "description_exact": "string",
    "merchant_exact": "string",
    "counterparty_exact": "string",
    "source_institution": "string",
    "card_alias": "string",
    "rule_fingerprint": "string",
    "is_enabled": "boolean",
    "created_by_user": "boolean",
    "created_seq": "bigint",
}

DECISION_FIELDS = {
    "id": "string",
    "transaction_id": "string",
    "nature": "string",
    "category_id": "string",
    "source": "string",
    "rule_id": "string",
    "matched_rule_ids": "array<string>",
    "reason_code": "string",
    "decided_at": "timestamp",
    "seq": "bigint",
}

REVIEW_EVENT_FIELDS = {
    "transaction_id": "string",
    "event": "string",
    "reason": "string",
    "candidate_rule_ids": "array<string>",
    "event_at": "timestamp",
    "seq": "bigint",
}

CORRECTION_FIELDS = {
    "id": "string",
    "transaction_id": "string",
    "previous_decision_id": "string",
    "new_decision_id": "string",
    "remembered_rule_id": "string",
    "created_at": "timestamp",
}

IMPORT_RUN_FIELDS = {
    "id": "string",
    "source_file_hash": "string",
    "source_institution": "string",
    "format_id": "string",
    "detection_status": "string",
    "ingestion_status": "string",
    "persistence_status": "string",
    "records_read": "bigint",
    "transactions_created": "bigint",
    "pending_created": "bigint",
    "duplicates_in_file": "bigint",
    "duplicates_in_database": "bigint",
    "records_rejected": "bigint",
    "issue_counts": "map<string,bigint>",
    "error_code": "string",
    "created_at": "timestamp",
}

# Rows that break a constraint of the table they were meant for.
QUARANTINE_FIELDS = {
    "target": "string",
    "row_id": "string",
    "import_id": "string",
    "violations": "array<string>",
    "row": "string",
}

# What became of each acceptable file of a batch; import_id is the import that holds its rows.
MANIFEST_FIELDS = {
    "path": "string",
    "modification_time": "timestamp",
    "length": "bigint",
    "source_file_hash": "string",
    "import_id": "string",
    "persistence_status": "string",
}

# Allowed words of the enumerated columns.
DIRECTIONS = ["inflow", "outflow"]
PAYMENT_METHODS = [
    "pix",
    "bank_transfer",
    "credit_card",
    "debit_card",
    "cash",
    "digital_wallet",
    "boleto",
    "other",
]
PAYMENT_INSTRUMENTS = [
    "bank_account",
    "credit_card",
    "debit_card",
    "wallet",
    "cash",
    "other",
]
NATURES = ["despesa", "receita", "transferencia_interna", "estorno"]
NATURES_WITH_CATEGORY = ["despesa", "receita"]


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())
