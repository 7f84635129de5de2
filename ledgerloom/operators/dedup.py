"""Duplicates inside a file, across files and across whole imports.

None of these collects a key group: firsts are map-side combined minima, and the
wide rows are matched back through :mod:`ledgerloom.operators.skew`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import pack_hex, unpack_hex
from ledgerloom.operators.skew import HOT_ROWS_MIN, hot_keys, lookup, mark_first


def mark_in_file_duplicates(rows: DataFrame, hot_rows_min: int = HOT_ROWS_MIN) -> DataFrame:
    """Adds is_duplicate: an earlier row of the same file has the same record hash.

    Hashes are shuffled as bytes, half as long as their digits.
    """
    packed = rows.withColumn("source_record_hash", pack_hex(F.col("source_record_hash")))
    marked = mark_first(
        packed, ["file_id", "source_record_hash"], ["row_number"], flag="_first_row", hot_rows_min=hot_rows_min
    )
    return (
        marked.withColumn("source_record_hash", unpack_hex(F.col("source_record_hash")))
        .withColumn("is_duplicate", ~F.col("_first_row"))
        .drop("_first_row")
    )


def skip_imported(files: DataFrame, import_runs: DataFrame, order: list[str]) -> DataFrame:
    """Adds already_imported: the same bytes are stored, or came earlier in this batch."""
    stored = (
        import_runs.where("persistence_status = 'stored' and source_file_hash is not null")
        .select("source_file_hash")
        .distinct()
        .withColumn("_stored", F.lit(True))
    )
    first = mark_first(files, ["source_file_hash"], order, flag="_first_copy")
    # One first copy per hash, so no hash can be hot on the joined side.
    firsts = first.where("_first_copy").join(stored, "source_file_hash", "left")
    repeats = first.where("not _first_copy").withColumn("_stored", F.lit(True))
    return (
        firsts.unionByName(repeats)
        .withColumn("already_imported", F.coalesce("_stored", F.lit(False)))
        .drop("_stored", "_first_copy")
    )


def resolve_duplicates(
    batch: DataFrame, stored: DataFrame | None = None, hot_rows_min: int = HOT_ROWS_MIN
) -> DataFrame:
    """Decide for every new transaction whether an earlier one already covers it.

    Both inputs need id, strong_dedup_key, semantic_fingerprint, transaction_date,
    import_seq and row_seq, (import_seq, row_seq) being the arrival order; stored
    rows precede the batch. A row with a strong key is a duplicate of the first row
    with that key and is never compared by meaning. A row without one is a duplicate
    when an earlier kept row, of either kind, has its fingerprint.

    Adds existing_transaction_id, detection_strategy and duplicate_status, all null
    for rows to keep.
    """
    narrow = ["id", "strong_dedup_key", "semantic_fingerprint", "import_seq", "row_seq"]
    known = batch.select(*narrow, F.lit(1).alias("_new"))
    if stored is not None:
        # Both keys hold the date, so only stored days seen in the batch can match.
        # There are only so many calendar days, which bounds this broadcast.
        days = batch.select("transaction_date").distinct()
        earlier = stored.join(F.broadcast(days), "transaction_date", "left_semi")
        known = known.unionByName(earlier.select(*narrow, F.lit(0).alias("_new")))

    def first_of(rows: DataFrame, key: str) -> DataFrame:
        first = F.struct("_new", "import_seq", "row_seq", "id", "semantic_fingerprint")
        return rows.groupBy(key).agg(
            F.sum("_asks").alias("_n"), F.count(F.lit(1)).alias("_all"), F.min(first).alias("_first")
        )

    strong = first_of(
        known.where("strong_dedup_key is not null").withColumn("_asks", F.col("_new")), "strong_dedup_key"
    )
    # Whatever comes first among kept strong rows and weak rows of a fingerprint is
    # itself kept, and it covers every later weak row.
    kept_strong = strong.select("_first.*", F.lit(0).alias("_asks"))
    weak_rows = known.where("strong_dedup_key is null").select(
        *[c for c in kept_strong.columns if c != "_asks"], F.col("_new").alias("_asks")
    )
    weak = first_of(weak_rows.unionByName(kept_strong), "semantic_fingerprint")
    # One lookup answers both kinds: a row asks by its strong key or its fingerprint.
    answers = strong.select(
        F.lit("external_id").alias("_strategy"), F.col("strong_dedup_key").alias("_key"), "_n", "_all", "_first"
    ).unionByName(
        weak.select(
            F.lit("semantic_fingerprint").alias("_strategy"),
            F.col("semantic_fingerprint").alias("_key"),
            "_n",
            "_all",
            "_first",
        )
    )
    contested = answers.where("_all > 1 and _n > 0")
    strong_row = F.col("strong_dedup_key").isNotNull()
    asking = batch.withColumn(
        "_strategy", F.when(strong_row, F.lit("external_id")).otherwise(F.lit("semantic_fingerprint"))
    ).withColumn("_key", F.coalesce("strong_dedup_key", "semantic_fingerprint"))
    asked = ["_strategy", "_key"]
    answered = lookup(
        asking,
        contested.select(*asked, "_first"),
        asked,
        ["id"],
        hot_keys(contested, asked, "_n", hot_rows_min),
    )
    covered = F.col("_first").isNotNull() & (F.col("_first.id") != F.col("id"))
    return answered.select(
        *batch.columns,
        F.when(covered, F.col("_first.id")).alias("existing_transaction_id"),
        F.when(covered, F.col("_strategy")).alias("detection_strategy"),
        F.when(covered & strong_row, F.lit("confirmed_duplicate"))
        .when(covered, F.lit("open_review"))
        .alias("duplicate_status"),
        F.when(covered, F.col("_key")).alias("duplicate_fingerprint"),
    )
