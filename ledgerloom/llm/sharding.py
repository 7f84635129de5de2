"""Shards that each match the mixture of sources, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import buckets_for, hash_bucket, running, source_key, stage

SHARDS = 40
OVERHEAD_BYTES = 16


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Assign every row to a shard; law `rows`: shard counts are at most one apart.

    Rows of a source are put in a seeded random order; row r of n gets the fraction (r - phase) / n,
    with a phase between 0 and 1 for each source, so that sources of equal size don't clump.
    Ordering all rows by fraction deals the sources evenly, and cutting that order into equal
    counts gives every shard the mixture of the whole.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32 (null text:
    that of the empty text), source, law, shard, slot (0.. without gaps in each shard),
    grown_shard (null: this law promises nothing about one more shard).
    A null source is a source of its own. Null or repeated doc_ids and equal rows are kept, each
    with its own slot; which of two equal rows gets which slot is open. An empty table gives no
    rows. Fewer rows than shards leave some shards empty. Other columns are ignored.
    """
    rows = stage(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            source_key().alias("_key"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        ).withColumn("_u", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")),
        "shard-rows",
    )
    total = rows.count()
    buckets = buckets_for(total)
    within = running(
        rows.withColumn("_bucket", hash_bucket(F.col("_u"), buckets)),
        ["_key"],
        "_bucket",
        [F.col("_u"), F.col("doc_id"), F.col("text_crc32"), F.col("size")],
        {"_rank": F.lit(1)},
        {"_rows": "_rank"},
    )
    phase = (F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))
    dealt = within.withColumn("_at", (F.col("_rank") - phase) / F.col("_rows")).withColumn(
        "_slice", F.floor(F.col("_at") * F.lit(buckets)).cast("long")
    )
    placed = running(dealt.drop("_bucket"), [], "_slice", [F.col("_at"), F.col("_key"), F.col("_rank")], {"_place": F.lit(1)})
    place = F.col("_place") - 1
    shard = F.floor(place * F.lit(shards) / F.lit(max(total, 1))) if total * shards < 2**52 else F.expr(f"(_place - 1) * {shards} div {total}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        "source",
        F.lit("rows").alias("law"),
        "shard",
        (place - F.expr(f"(cast(shard as bigint) * {max(total, 1)}L + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
