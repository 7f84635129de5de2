"""Row constraints enforced before the write: rows that break one are kept apart, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.checks import candidate_violations, decision_violations, pending_violations, transaction_violations


def transactions(rows: DataFrame) -> DataFrame:
    """Adds violations."""
    return rows.withColumn("violations", transaction_violations())


def decisions(rows: DataFrame) -> DataFrame:
    """Adds violations."""
    return rows.withColumn("violations", decision_violations())


def pendings(rows: DataFrame) -> DataFrame:
    """Adds violations, those of the candidate too."""
    flat = rows.select(*rows.columns, "candidate.*")
    return flat.withColumn("violations", F.concat(pending_violations(), candidate_violations())).select(*rows.columns, "violations")


def kept(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def held(checked: DataFrame, target: str, import_id: Column | None = None) -> DataFrame:
    """Rows of the quarantine table: target, row_id, import_id, violations, the row as JSON."""
    own = [c for c in checked.columns if c != "violations"]
    return checked.where(F.size("violations") > 0).select(
        F.lit(target).alias("target"),
        F.col("id").alias("row_id"),
        (F.lit(None).cast("string") if import_id is None else import_id).alias("import_id"),
        "violations",
        F.to_json(F.struct(*own)).alias("row"),
    )
