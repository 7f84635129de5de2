"""Differences between a file and the format it was recognised as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import let


def _change(code: str, severity: Column, fields: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"), severity.alias("severity"), fields.alias("fields")
    )


def schema_changes(columns: Column, delimiter: Column, irregular_rows: Column, spec: Column) -> Column:
    """array<struct(code, severity, fields)>, in the order the checks are listed."""
    warning, blocking = F.lit("warning"), F.lit("blocking")
    none = F.array().cast("array<string>")
    expected = spec["expected_columns"]
    groups = spec["required_any_groups"]
    missing = F.array_sort(F.array_except(expected, columns))
    unexpected = F.array_sort(F.array_except(columns, expected))
    absent_groups = F.filter(groups, lambda g: ~F.arrays_overlap(g, columns))
    required_gone = F.arrays_overlap(missing, spec["required_columns"]) | (F.size(absent_groups) > 0)
    unreported = F.filter(absent_groups, lambda g: ~F.arrays_overlap(g, missing))
    shared_here = F.filter(columns, lambda c: F.array_contains(expected, c))
    shared_there = F.filter(expected, lambda c: F.array_contains(columns, c))
    return F.array_compact(
        F.concat(
            F.array(
                F.when(
                    F.size(missing) > 0,
                    _change("missing_column", F.when(required_gone, blocking).otherwise(warning), missing),
                )
            ),
            F.transform(unreported, lambda g: _change("missing_minimum_column", blocking, F.array_sort(g))),
            F.array(
                F.when(F.size(unexpected) > 0, _change("unexpected_column", warning, unexpected)),
                F.when(delimiter != spec["delimiter"], _change("delimiter_changed", warning, none)),
                F.when(shared_here != shared_there, _change("column_order_changed", warning, none)),
                F.when(irregular_rows > 0, _change("irregular_row_width", warning, none)),
            ),
        )
    )


def is_breaking(changes: Column) -> Column:
    return F.coalesce(F.exists(changes, lambda c: c["severity"] == "blocking"), F.lit(False))


def with_drift(detected: DataFrame) -> DataFrame:
    """Adds drift (null without a selected spec) and drift_breaking."""
    changes = let(
        F.col("selected_spec"),
        lambda spec: F.when(
            spec.isNotNull(),
            schema_changes(F.col("columns"), F.col("delimiter"), F.col("irregular_row_count"), spec),
        ),
    )
    return detected.withColumn("drift", changes).withColumn("drift_breaking", is_breaking(F.col("drift")))
