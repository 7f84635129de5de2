"""Helpers shared by the operators: shared folder, staged tables, distributed running sums."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word pattern `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle files are dropped with the write that made them, not when the driver happens to collect garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: `spark.checkpoint.dir`.

    Only where the session has none (tests, a laptop) a local one is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a reader of it.

    Cuts lineage: a lost executor costs the tasks after this point, never the ones before.
    The files lie in a folder named after the application, to be dropped when it has ended. Shuffle
    files of the write go when it has ended: nothing reads them again.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/staged-{app}/{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def source_key(source: str = "source") -> Column:
    """Text key of a source, never null; code point order, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def buckets_for(rows: int) -> int:
    """Buckets of a distributed ranking: as many as rows in each, so neither side outgrows a task."""
    return max(1, math.isqrt(max(rows, 1)))


def hash_bucket(value: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a 64-bit hash, ascending with the hash."""
    top = F.shiftrightunsigned(value.bitwiseXOR(F.lit(-(2**63))), 33)
    return F.floor(top * F.lit(buckets) / F.lit(float(2**31))).cast("long")


def running(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[Column],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums within keys, in the order (bucket, order), without one task per key.

    Rows of a bucket are summed by a window of their own; what lies before the bucket comes from
    one small row per (keys, bucket). sums: output column -> value; the sum includes the row itself.
    totals: output column -> name in sums whose total over the keys is wanted. Null values count 0.
    """
    totals = totals or {}
    values = {name: F.coalesce(value, F.lit(0)).cast("long") for name, value in sums.items()}
    df = df.withColumns({f"_v_{name}": value for name, value in values.items()})
    at = [*keys, bucket]
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        df.groupBy(*at)
        .agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums])
        .select(
            *at,
            *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums],
            *[F.sum(f"_s_{name}").over(before).alias(out) for out, name in totals.items()],
        )
    )
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumns({f"_w_{name}": F.sum(f"_v_{name}").over(inside) for name in sums})
    return (
        ranked.join(parts, at)
        .withColumns({name: F.col(f"_b_{name}") + F.col(f"_w_{name}") for name in sums})
        .drop(*[f"_{x}_{name}" for x in "vbw" for name in sums])
    )
