"""Nearest neighbours by a hash-prefix forest: sorted arrays of long hash strings, one per tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

TREES = 16
BITS = 31
#: Candidates a query asks for before it stops ascending, as a share of all vectors; those found in several trees count in each.
CANDIDATE_SHARE = 0.75
LEAST_CANDIDATES = 2000
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
#: Rows that fit the hash functions, in order of a hash of vec_id.
SAMPLE_ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: vectors that take part.

    Not: null vec_id, null, empty or zero vectors, null or non-finite components, and vectors of
    another length than the most common one (of equally common lengths the smallest). Of several
    rows of one vec_id the smallest vector counts.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(sound)
    one = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("v"))
    kept = stage(one, "forest-vectors")
    width = kept.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return kept.filter(F.size("v") == (width["d"] if width else 0))


def _emit_strings(planes, cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            v = batch.column("v")
            if not len(v):
                continue
            matrix = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
            bits = matrix @ planes.value.T > cuts.value
            strings = (bits.reshape(len(v), -1, BITS) * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(list(strings), pa.list_(pa.int64()))], names=["vec_id", "v", "strings"])

    return run


def index(vectors: DataFrame, trees: int = TREES, seed: int = 5) -> DataFrame:
    """vec_id, v, strings: the hash string of every vector in every tree.

    A bit tells on which side of a random hyperplane the vector lies; planes go through the median
    of a bounded sample (SAMPLE_ROWS), so that a bit halves the vectors.
    """
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    known = np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), len(sample[0]["v"]) if sample else 0)
    planes = np.random.default_rng(seed).standard_normal((trees * BITS, known.shape[1]))
    cuts = np.median(known @ planes.T, axis=0) if len(sample) else np.zeros(len(planes))
    context = vectors.sparkSession.sparkContext
    kind = vectors.schema["v"].dataType.simpleString()
    hashed = vectors.mapInArrow(_emit_strings(context.broadcast(planes), context.broadcast(cuts)), f"vec_id long, v {kind}, strings array<bigint>")
    return stage(hashed, "forest-index")


def nearest_in(block: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows of block, nearest first, ties to the smaller id."""
    apart = block - query
    far = np.sqrt((apart * apart).sum(axis=1))
    far[ids == own] = np.inf
    if len(far) > k:
        close = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
    else:
        close = np.arange(len(far))
    close = close[np.isfinite(far[close])]
    close = close[np.lexsort((ids[close], far[close]))][:k]
    return ids[close], far[close]


def _search_block(k: int):
    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            block = block.sort_values(["string", "vec_id"], ignore_index=True)
            strings, ids = block["string"].to_numpy(), block["vec_id"].to_numpy()
            matrix = np.stack(block["v"].to_list()).astype(np.float64)
            for query, v, string, level in zip(asked["query_id"], asked["point"], asked["string"], asked["level"], strict=True):
                low = int(string) >> (BITS - int(level)) << (BITS - int(level))
                i, j = np.searchsorted(strings, [low, low + (1 << (BITS - int(level)))])
                found, far = nearest_in(matrix[i:j], ids[i:j], np.asarray(v, dtype=np.float64), query, k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": found, "score": far}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    trees: int = TREES,
    share: float = CANDIDATE_SHARE,
    least: int = LEAST_CANDIDATES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, nearest first.

    vectors: vec_id, embedding. queries: their vec_ids (default: those divisible by 100); a query
    is compared with every candidate but itself.

    Every query descends all trees to the vectors that share its string's prefix, and ascends them
    together, a bit at a time, until the prefixes hold enough vectors; all of these are compared.
    The arrays are cut into blocks by prefix, large blocks (equal vectors) by vec_id, and queries
    travel to the blocks they need, so a task holds one block.
    See usable() for rows that take no part. Fewer than k other vectors: all of them. An empty
    table gives no rows.
    """
    ready = usable(vectors)
    indexed = index(ready, trees)
    n = indexed.count()
    enough = max(least, math.ceil(share * n))
    deepest = min(BITS, max(0, math.ceil(math.log2(max(1, trees * n / enough))) + 6))
    cut = min(deepest, max(0, math.floor(math.log2(max(1, n / BLOCK_ROWS)))))
    asking = indexed.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id") if queries is not None else indexed.filter("vec_id % 100 = 0")
    asking = asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("point"), F.posexplode("strings").alias("tree", "string"))
    arrays = indexed.select("vec_id", "v", F.posexplode("strings").alias("tree", "string"))

    prefix = lambda level: F.shiftright("string", BITS - level)
    levels = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), prefix(x).alias("prefix")) for x in range(deepest + 1)])).alias("p")
    leaves = arrays.groupBy("tree", prefix(deepest).alias("leaf")).agg(F.count("*").alias("n"))
    lifted = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.shiftright("leaf", deepest - x).alias("prefix")) for x in range(deepest + 1)])).alias("p")
    sizes = leaves.select("tree", "n", lifted).groupBy("tree", "p.level", "p.prefix").agg(F.sum("n").alias("n"))
    reach = asking.select("query_id", "tree", levels).select("query_id", "tree", "p.*").join(sizes, ["tree", "level", "prefix"])
    reach = reach.groupBy("query_id", "level").agg(F.sum("n").alias("n")).filter(F.col("n") >= min(enough, trees * n))
    stops = reach.groupBy("query_id").agg(F.max("level").alias("level"))

    spread = leaves.groupBy("tree", F.shiftright("leaf", deepest - cut).alias("block")).agg(F.sum("n").alias("n"))
    spread = spread.select("tree", "block", F.ceil(F.col("n") / BLOCK_ROWS).alias("salts"))
    # A level above the cut needs every block below its prefix.
    wide = F.when(F.col("level") >= cut, F.lit(0)).otherwise(cut - F.col("level")).cast("int")
    base = F.when(F.col("level") >= cut, F.shiftright("string", BITS - cut)).otherwise(
        F.expr(f"shiftleft(shiftright(string, {BITS} - level), cast(greatest(0, {cut} - level) as int))")
    )
    visits = asking.join(stops, "query_id").select("query_id", "point", "tree", "string", "level", base.alias("_base"), F.pow(F.lit(2.0), wide).cast("long").alias("_blocks"))
    visits = visits.withColumn("block", F.explode(F.expr("sequence(_base, _base + _blocks - 1)"))).drop("_base", "_blocks").join(spread, ["tree", "block"])
    load = visits.groupBy("tree", "block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("parts"))
    key = ["tree", "block", "salt", "part"]
    left = (
        arrays.withColumn("block", prefix(cut))
        .join(spread.join(load, ["tree", "block"]), ["tree", "block"])
        .withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
        .withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        .select(*key, "vec_id", "v", "string")
    )
    right = (
        visits.join(load, ["tree", "block"])
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
        .withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))
        .select(*key, "query_id", "point", "string", "level")
    )
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search_block(k), "query_id long, vec_id long, score double")
    unique = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
