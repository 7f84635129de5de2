"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage


#: Edges of one partition; a round over few edges makes few small files.
PARTITION_EDGES = 100_000
LEAST_PARTITIONS = 8


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node of edges (a, b: orderable, not null).

    Each round links every neighbour to the smallest one it knows of; only minima are aggregated,
    so a node of any degree costs one row per edge. Rounds grow with the logarithm of the size.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark = _mark(now)
    while True:
        # As many partitions as edges ask for, where shuffles make more.
        parts = max(LEAST_PARTITIONS, 2 * mark[0] // PARTITION_EDGES)
        kept = lambda rows, label: stage(rows.coalesce(parts), label)  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-lowest")
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = kept(large, "edges")
        lowest = kept(large.groupBy("u").agg(F.min("v").alias("m")), "edges-lowest")
        small = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root as components() gives them when `edges` (a, b) join those that `roots` came from.

    Only edges between different components count, each component being one node.
    """
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = stage(ends.filter("a != b").distinct(), "edges-between")
    if between.isEmpty():
        return roots
    joined = stage(components(between), "roots-joined")
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    new = joined.join(roots.select("node"), "node", "left_anti")
    return stage(moved.select("node", F.coalesce("_to", "root").alias("root")).unionByName(new.select("node", "root")), "roots")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
