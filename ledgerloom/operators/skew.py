"""Joins and first-row tests that stay balanced when one key holds much of the data.

The pattern: hot keys are found by a map-side combined count, their few rows are
broadcast, and the matching rows of the large side are spread over all tasks
instead of being hashed to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above both bounds. A share of one in HOT_KEYS_MAX means there can be
# at most that many hot keys, which is what makes broadcasting them safe.
HOT_KEYS_MAX = 100_000
HOT_ROWS_MIN = 1_000_000
BROADCAST_ROWS_MAX = 100_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, hot_rows_min: int = HOT_ROWS_MIN) -> DataFrame:
    """Keys of ``counts`` (one row per key with its row count ``n``) that are hot."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.where((F.col(n) > hot_rows_min) & (F.col(n) * HOT_KEYS_MAX > total)).select(*keys)


def is_small(frame: DataFrame, rows: int = BROADCAST_ROWS_MAX) -> bool:
    """Checked size bound; stops reading after ``rows`` + 1 rows."""
    return frame.limit(rows + 1).count() <= rows


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    hot: DataFrame,
) -> DataFrame:
    """Left join to ``right`` (unique per key) with hot and null keys spread out.

    ``hot`` has at most HOT_KEYS_MAX keys, so its part of ``right`` is broadcast;
    all other keys are joined by shuffle, where ``_spread`` keeps the rows already
    answered, and rows without a key, away from any single task.
    """
    values = [c for c in right.columns if c not in keys]
    hot_right = right.join(F.broadcast(hot), keys, "left_semi").select(
        *keys, F.struct(*values).alias("_hot")
    )
    cold_right = right.join(F.broadcast(hot), keys, "left_anti").select(
        *keys, F.lit(0).cast("bigint").alias("_spread"), F.struct(*values).alias("_cold")
    )
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    joined = (
        left.join(F.broadcast(hot_right), keys, "left")
        .withColumn(
            "_spread",
            F.when(F.col("_hot").isNotNull() | no_key, F.xxhash64(*spread_by)).otherwise(F.lit(0)),
        )
        .join(cold_right, [*keys, "_spread"], "left")
    )
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values],
    )


def lookup_dimension(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], small: bool | None = None
) -> DataFrame:
    """Left join to a dimension unique per key: broadcast if checked small, else spread."""
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), keys, "left").select(
            *left.columns, *[c for c in right.columns if c not in keys]
        )
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return lookup(left, right, keys, spread_by, hot_keys(counts, keys, "_n"))


def mark_first(
    frame: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str] | None = None,
    flag: str = "is_first",
    hot_rows_min: int = HOT_ROWS_MIN,
) -> DataFrame:
    """Adds ``flag``: no earlier row (by ``order``, a total order) has the same keys.

    ``carry`` columns of the first row come back as ``first_<name>`` on later rows.
    One map-side combined aggregation finds the firsts; only keys that repeat are
    joined back, so unique rows are matched against a small table.
    """
    carry = carry or []
    repeated = (
        frame.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *carry)).alias("_first"),
        )
        .where("_n > 1")
    )
    right = repeated.select(*keys, "_first")
    joined = lookup(frame, right, keys, order, hot_keys(repeated, keys, "_n", hot_rows_min))
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & (F.col(c) == F.col("_first")[f"o{i}"])
    later = F.col("_first").isNotNull() & ~same
    return joined.select(
        *frame.columns,
        (~later).alias(flag),
        *[F.when(later, F.col("_first")[c]).alias(f"first_{c}") for c in carry],
    )

