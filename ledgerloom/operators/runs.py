"""Ordered neighbours and running counts per key, safe for very long histories.

A plain window sends a whole key to one task. Here the rows of hot keys are sorted across
tasks by key and order and cut into runs of about RUN_ROWS rows, wherever they lie in time:
the window works per (key, run), and only one summary row per run crosses run borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.skew import HOT_ROWS_MIN, hot_keys, is_small
from ledgerloom.sources.store import stage_shared

RUN_ROWS = 1_000_000


def _cut(frame: DataFrame, key: str, order: list[str], hot_rows_min: int) -> DataFrame:
    """Adds _hot and _run: null for ordinary keys, else the range of (key, order) the row is in."""
    counts = frame.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, [key], "_n", hot_rows_min)
    unmarked = {"_hot": F.lit(None).cast("boolean"), "_run": F.lit(None).cast("int")}
    if is_small(hot, 0):
        return frame.withColumns(unmarked)
    marked = F.broadcast(hot)
    rows = frame.join(marked, key, "left_semi")
    runs = -(-rows.count() // RUN_ROWS)
    ranges = rows.repartitionByRange(runs, key, *order).withColumn("_hot", F.lit(True)).withColumn("_run", F.spark_partition_id())
    # Stored, as the sample that sets the ranges may differ from one reading to the next.
    return frame.join(marked, key, "left_anti").withColumns(unmarked).unionByName(stage_shared(ranges, "runs"))


def _in_run(key: str, order: list[str]) -> Window:
    return Window.partitionBy(key, "_run").orderBy(*order)


def _with_summary(cut: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Join one summary row per run back; ordinary keys have no run and no summary.

    Runs are about RUN_ROWS rows of one key; rows of ordinary keys are spread by key.
    """
    return cut.join(
        summary.withColumnRenamed(key, "_k").withColumnRenamed("_run", "_r"),
        (F.col(key) == F.col("_k")) & F.col("_hot") & (F.col("_run") == F.col("_r")),
        "left",
    )


def neighbours(
    frame: DataFrame,
    key: str,
    order: list[str],
    values: list[str],
    following: bool,
    hot_rows_min: int = HOT_ROWS_MIN,
) -> DataFrame:
    """Adds next_<value> (or previous_<value>) of the adjacent row with the same key.

    ``order`` must be total.
    """
    cut = _cut(frame, key, order, hot_rows_min)
    prefix = "next" if following else "previous"
    packed = F.struct(*values)
    within = _in_run(key, order)
    shifted = F.lead(packed) if following else F.lag(packed)
    edge = F.min_by if following else F.max_by
    borders = (
        cut.where("_hot").groupBy(key, "_run").agg(edge(packed, F.struct(*order)).alias("_edge"))
    )
    between = Window.partitionBy(key).orderBy("_run")
    over = F.lead("_edge") if following else F.lag("_edge")
    borders = borders.withColumn("_beyond", over.over(between)).drop("_edge")
    joined = _with_summary(cut.withColumn("_near", shifted.over(within)), borders, key)
    near = F.coalesce(F.col("_near"), F.col("_beyond"))
    return joined.select(*frame.columns, *[near[v].alias(f"{prefix}_{v}") for v in values])


def running_count(
    frame: DataFrame,
    key: str,
    order: list[str],
    counted: Column,
    name: str,
    hot_rows_min: int = HOT_ROWS_MIN,
) -> DataFrame:
    """Adds ``name``: how many strictly earlier rows of the key satisfy ``counted``."""
    cut = _cut(frame, key, order, hot_rows_min).withColumn("_one", F.when(counted, 1).otherwise(0))
    before = _in_run(key, order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.where("_hot").groupBy(key, "_run").agg(F.sum("_one").alias("_total"))
    earlier_runs = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.sum("_total").over(earlier_runs)).drop("_total")
    joined = _with_summary(cut.withColumn("_within", F.sum("_one").over(before)), offsets, key)
    return joined.select(
        *frame.columns,
        (F.coalesce("_within", F.lit(0)) + F.coalesce("_offset", F.lit(0))).cast("bigint").alias(name),
    )
