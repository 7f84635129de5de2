"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, buckets_for, hash_bucket, running, source_key, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_TOKENS = 256
#: Ranges of the unit interval that meet the sources' intervals by equality.
CELLS = 4096

getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
_LOW_BITS = 20


def golden_point(index: Column) -> Column:
    """Fraction of index times the golden ratio, exact to about 1e-10 up to 2**50 indexes."""
    high, low = F.shiftright(index, _LOW_BITS), index.bitwiseAND(F.lit(2**_LOW_BITS - 1))
    steps = [float(_GOLDEN * 2**_LOW_BITS % 1), float(_GOLDEN)]
    parts = [x * F.lit(step) - F.floor(x * F.lit(step)) for x, step in zip((high, low), steps, strict=True)]
    both = parts[0] + parts[1]
    return both - F.floor(both)


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """Target of each source: share of all sizes by weight, at most `repeats` times its own size.

    sizes: _key, source_size. Sources in code point order (null last) take the weights in turn.
    What a capped source cannot take goes to the others by weight, until none is above its cap:
    with sources ordered by cap / weight, the capped ones are a prefix of that order, found by
    running sums. One row per source; its windows have a row per source, not per document.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_turn", (F.row_number().over(everything.orderBy("_key")) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") + 1).cast("int"))
    )
    level = everything.orderBy(F.col("source_size") * repeats / F.col("weight"), "_key")
    upto = level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = (
        ranked.withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_free", F.col("_all") - F.sum("_cap").over(upto) + F.col("_cap"))
        .withColumn("_open", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("_level", F.col("_free") / F.col("_open"))
    )
    # The first source whose even share fits under its cap fixes the level of all that follow.
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    found = F.first(fits, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("_cap"), F.coalesce(found, F.lit(float("inf"))) * F.col("weight"))
    return shared.select("_key", "source_size", "weight", target.alias("target"))


def _schedule(spark, goals: DataFrame, slots: int) -> DataFrame:
    """slot, _key, _turn: the source of every slot and its rank among that source's slots."""
    everything = Window.partitionBy(F.lit(0)).orderBy("_key")
    ends = goals.filter("target > 0").select(
        "_key",
        (F.sum("target").over(everything.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("_end"),
        F.sum("target").over(Window.partitionBy(F.lit(0))).alias("_sum"),
        F.col("target").alias("_t"),
    )
    spans = ends.select("_key", ((F.col("_end") - F.col("_t")) / F.col("_sum")).alias("_from"), (F.col("_end") / F.col("_sum")).alias("_to"))
    cells = spans.select(
        "*",
        F.explode(F.sequence(F.floor(F.col("_from") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("_to") * CELLS)))).alias("_cell"),
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id") + 1).alias("_x"))
    met = (
        points.withColumn("_cell", F.floor(F.col("_x") * CELLS))
        .join(cells, "_cell")
        .filter("_x >= _from and _x < _to")
        .select("slot", "_key", F.floor(F.col("slot") / buckets_for(slots)).alias("_bucket"))
    )
    return running(met, ["_key"], "_bucket", [F.col("slot")], {"_turn": F.lit(1)}, {"_turns": "_turn"}).drop("_bucket")


def mix(
    docs: DataFrame,
    share: float = SHARE,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MOST_REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 23,
) -> tuple[DataFrame, DataFrame]:
    """Mix documents to their sources' targets; returns (documents, pieces).

    The documents of a source are laid end to end in a seeded random order, anew for each of
    `repeats` passes, and what the target takes of that line is cut into blocks of equal tokens
    (about block_tokens). Points of the golden ratio pass through the cumulative targets: each is
    a slot and names a source; the r-th slot of a source takes its r-th block. A source whose
    share holds no point gets one block, after all slots.

    documents: doc_id, source, size (words; null text: 0), source_size, target, weight, _key, _pos
    (its place in the source), and taken (words taken, repeats counted).
    pieces: slot, _key, _pos, doc_id, pass, first (word of the document, from 0), words: the mixture
    itself in slot order.
    Null source: a source of its own, last. Null or repeated doc_ids are documents of their own.
    Empty texts have size 0 and are never taken. An empty table gives none. Same rows and seed,
    same result (equal rows are interchangeable).
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            source_key().alias("_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _identity(seed).alias("_u"),
        ),
        "mix-rows",
    )
    count = rows.count()
    buckets = buckets_for(count)
    order = [F.col("_u"), F.col("doc_id"), F.col("size")]
    placed = stage(
        running(rows.withColumn("_bucket", hash_bucket(F.col("_u"), buckets)), ["_key"], "_bucket", order, {"_pos": F.lit(1)}).drop("_bucket"),
        "mix-placed",
    )
    goals = stage(targets(placed.groupBy("_key").agg(F.sum("size").alias("source_size")), share, weights, repeats), "mix-goals")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    slots = max(1, round(total / block_tokens)) if total else 0

    passes = placed.filter("size > 0").select("doc_id", "_key", "_pos", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"))
    passes = passes.withColumn("_w", F.xxhash64(F.lit(seed), "pass", "_pos", "_key")).withColumn("_bucket", hash_bucket(F.col("_w"), buckets))
    line = running(passes, ["_key", "pass"], "_bucket", [F.col("_w"), F.col("_pos")], {"_end": F.col("size")}).drop("_bucket", "_w")

    turns = _schedule(spark, goals, slots)
    per_source = goals.filter("target > 0").join(turns.groupBy("_key").agg(F.count("*").alias("_n")), "_key", "left")
    per_source = per_source.select(
        "_key", "source_size", F.round("target").cast("long").alias("_take"), F.coalesce("_n", F.lit(1)).alias("_n"), F.col("_n").isNull().alias("_late")
    ).filter("_take > 0")
    # Staged, so that joins by source read plain shuffles and a large source can be split.
    per_source = stage(per_source, "mix-sources")
    turns = turns.select("slot", "_key", (F.col("_turn") - 1).alias("_block")).unionByName(
        per_source.filter("_late").select(F.lit(slots).cast("long").alias("slot"), "_key", F.lit(0).cast("long").alias("_block"))
    )
    cut = (
        line.join(per_source, "_key")
        .withColumn("_to", F.col("_end") + F.col("pass") * F.col("source_size"))
        .withColumn("_from", F.col("_to") - F.col("size"))
        .filter("_from < _take")
        .withColumn("_upto", F.least("_to", "_take"))
    )
    # Block b of n covers the words from floor(b * take / n) on; the last row's block is found by rounding down.
    edge = lambda b: F.floor(b.cast("decimal(38,0)") * F.col("_take") / F.col("_n")).cast("long")
    guess = lambda word: F.floor(word.cast("double") * F.col("_n") / F.col("_take")).cast("long")
    blocks = cut.select(
        "*",
        F.explode(
            F.sequence(F.greatest(F.lit(0).cast("long"), guess(F.col("_from")) - 1), F.least(F.col("_n") - 1, guess(F.col("_upto")) + 1))
        ).alias("_block"),
    )
    start, stop = F.greatest(F.col("_from"), edge(F.col("_block"))), F.least(F.col("_upto"), edge(F.col("_block") + 1))
    blocks = blocks.withColumn("_start", start).withColumn("words", stop - F.col("_start")).filter("words > 0")
    pieces = turns.join(blocks, ["_key", "_block"]).select(
        "slot", "_key", "_pos", "doc_id", "pass", (F.col("_start") - F.col("_from")).alias("first"), "words"
    )
    pieces = stage(pieces, "mix-pieces")
    taken = pieces.groupBy("_key", "_pos").agg(F.sum("words").alias("taken"))
    documents = (
        placed.join(taken, ["_key", "_pos"], "left")
        .join(goals, "_key")
        .select("doc_id", "source", "size", "source_size", "target", "weight", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "_key", "_pos", "_u")
    )
    return documents, pieces


def mixed_documents(docs: DataFrame, seed: int = 23, **options) -> DataFrame:
    """The rows of docs as often as mix() takes them, in no order.

    A document that a pass takes in part (one per source and pass at most) is cut to those words,
    put together with single spaces. Rows that repeat stay as many as the mix takes of them.
    """
    documents, pieces = mix(docs, seed=seed, **options)
    passes = pieces.groupBy("_key", "_pos", "pass").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    wanted = passes.join(documents.select("_key", "_pos", "_u", "size"), ["_key", "_pos"])
    wanted = stage(wanted.groupBy("_u").agg(F.collect_list(F.struct("first", "words", "size")).alias("_takes")), "mix-wanted")
    rows = docs.withColumn("_u", _identity(seed))
    if not documents.groupBy("_u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["_u"])
    taken = rows.join(wanted, "_u").withColumn("_take", F.explode("_takes"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.col("_take.first").cast("int") + 1, F.col("_take.words").cast("int")), " ")
    whole = F.col("_take.words") == F.col("_take.size")
    return taken.withColumn("text", F.when(whole, F.col("text")).otherwise(part)).select(*docs.columns)


def _identity(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))
