"""Near-duplicate texts by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage
from ledgerloom.llm.components import components, extended

SHINGLE = 5
SIMILARITY = 0.8
#: Minima that make up one sketch, in text order, and independent sketches per text. Texts of
#: similarity 0.8 share a sketch with probability 0.8**4, so fewer than two of 24 in 6 of 100,000 cases.
ORDER = 4
SKETCHES = 24
LEAST_SHARED = 2
#: Members of a bucket that are all compared; in larger ones each meets hubs and its next neighbours,
#: and those still apart meet by their rarest shingles.
SMALL_BUCKET = 16
NEIGHBOURS = 3
#: Texts of fewer shingles than SHORT get so many more sketches of one minimum: of few shingles, four
#: minima agree too seldom.
SHORT = 12
SHORT_SKETCHES = 12
#: Bits that stand for a text's shingles in the join by rarest shingles.
MARK_BITS = 256

_WORD = re.compile(r"\w+")
_SEEDS = np.random.default_rng(20240601).integers(1, 2**63, 512, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of each text's runs of k words, in order; one run of all words if there are fewer."""
    words = [_WORD.findall(t.lower()) for t in texts]
    flat = [w for ws in words for w in ws]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.zeros(max(n, k), np.uint64)
        h[:n] = hashed[at : at + n]
        at += n
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            total = _mix(total + h[i : i + len(total)] + _SEEDS[i])
        out.append(total)
    return out


def labelled(run: np.ndarray) -> np.ndarray:
    """Hashes with the number of earlier equal ones mixed in, so that repeats count apart."""
    order = np.argsort(run, kind="stable")
    ordered = run[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    nth = np.arange(len(run)) - np.repeat(starts, np.diff(np.append(starts, len(run))))
    out = np.empty_like(run)
    out[order] = _mix(ordered + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketches(run: np.ndarray, count: int = SKETCHES, size: int = ORDER, skip: int = 0) -> np.ndarray:
    """One key per sketch: the shingles with the `size` smallest labelled hashes, in text order.

    skip: number of the first sketch; sketches of other numbers never agree.
    """
    n = len(run)
    size = min(size, n)
    if not n:
        return np.zeros(0, np.int64)
    labels = labelled(run)
    keys = np.empty(count, np.uint64)
    step = max(1, 4_000_000 // n)
    for j in range(0, count, step):
        seeds = _SEEDS[8 + skip + j : 8 + skip + min(count, j + step)]
        ranks = _mix(labels[None, :] ^ seeds[:, None])
        chosen = np.sort(np.argpartition(ranks, size - 1, axis=1)[:, :size], axis=1)
        key = seeds.copy()
        for i in range(size):
            key = _mix(key + run[chosen[:, i]])
        keys[j : j + len(seeds)] = key
    return keys.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Longest common subsequence of a and b if it is at least `least`; else some smaller number.

    An alignment with that many matches strays from the diagonal by no more than its gaps allow.
    Within this band the columns of a row are bits of one integer: a 0 marks where the length of
    the subsequence rises.
    """
    gaps = len(a) + len(b) - 2 * least
    if gaps < abs(len(a) - len(b)):
        return 0
    above = (gaps - (len(a) - len(b))) // 2
    below = (gaps + (len(a) - len(b))) // 2
    width = above + below + 1
    full = (1 << width) - 1
    places: dict[int, list[int]] = {}
    for j, c in enumerate(b.tolist()):
        places.setdefault(c, []).append(j)
    held: dict[int, list[int]] = {}
    row, length = full, 0
    for i, c in enumerate(a.tolist()):
        base = i - below
        found = places.get(c)
        if found:
            if len(found) <= 4:
                match = 0
                for j in found:
                    if 0 <= j - base < width:
                        match |= 1 << (j - base)
            else:
                state = held.get(c)
                if state is None:
                    state = held[c] = [0, base, bisect_left(found, base)]
                match = state[0] >> (base - state[1])
                nxt = state[2]
                while nxt < len(found) and found[nxt] < base + width:
                    if found[nxt] >= base:
                        match |= 1 << (found[nxt] - base)
                    nxt += 1
                state[:] = match, base, nxt
            hit = row & match
            if hit:
                row = ((row + hit) | (row - hit)) & full
        if not row & 1:
            length += 1
        row = (row >> 1) | (1 << (width - 1))
    return length + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles aligned in order over all shingles of both, or 0 if that is less than `least`."""
    if not len(a) or not len(b):
        return 0.0
    need = int(np.ceil(least * (len(a) + len(b)) / (1 + least) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    if len(a) == len(b) and (a == b).all():
        return 1.0
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need:
        return 0.0
    m = min(len(a), len(b))
    head = int(np.argmax(np.append(a[:m] != b[:m], True)))
    tail = int(np.argmax(np.append(a[::-1][: m - head] != b[::-1][: m - head], True)))
    both = head + tail + aligned(a[head : len(a) - tail], b[head : len(b) - tail], max(0, need - head - tail))
    return both / (len(a) + len(b) - both) if both >= need else 0.0


# --- jobs ------------------------------------------------------------------------------------


def text_keys(run: np.ndarray) -> np.ndarray:
    """All sketches of a text's shingles."""
    if not 0 < len(run) < SHORT:
        return sketches(run)
    return np.concatenate((sketches(run), sketches(run, SHORT_SKETCHES, 1, SKETCHES)))


def _emit_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keys, group, size = [], [], 0
        for i, text in enumerate(texts):
            group.append(text or "")
            size += len(group[-1])
            if size > 1_000_000 or i + 1 == len(texts):
                keys.extend(map(text_keys, shingles(group)))
                group, size = [], 0
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], names=["node", "doc_id", "keys"])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, yes = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for one, other in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = shingles([one, other])
                yes.append(similarity(x, y, least))
            keep = [i for i, s in enumerate(yes) if s]
            columns = [pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary()), pa.array([yes[i] for i in keep], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b: nodes, keys_a, keys_b) whose texts are similar enough."""
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    return _compared(pairs.filter(shared >= LEAST_SHARED).select("a", "b"), texts, least)


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b: nodes) whose texts are similar enough."""
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least), "a binary, b binary, similarity double")


def _keyed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    with_a = pairs.join(known.select(F.col("node").alias("a"), F.col("keys").alias("keys_a")), "a")
    return with_a.join(known.select(F.col("node").alias("b"), F.col("keys").alias("keys_b")), "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bucket_pairs(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """All pairs of different roots within buckets of at most SMALL_BUCKET members."""
    small = rows.join(counts.filter(F.col("n") <= SMALL_BUCKET).select("key"), "key")
    lists = small.groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("m"))
    others = F.flatten(
        F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & (y["root"] != x["root"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))))
    )
    return lists.select(F.explode(others).alias("p")).select("p.a", "p.b").distinct()


def _counts(rows: DataFrame) -> DataFrame:
    """Buckets that hold two roots or more, with their number of members."""
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return found.filter("lo != hi").select("key", "n")


def _hub_pairs(rows: DataFrame, counts: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pairs of every member of the buckets with the member that shares most buckets with others."""
    weighed = rows.join(counts, "key").join(degrees, "node")
    hubs = stage(weighed.groupBy("key").agg(F.max(F.struct("degree", "node", "root")).alias("hub")), "near-hubs")
    pairs = rows.join(hubs, "key").filter("root != hub.root")
    return pairs.select(*_ordered(F.col("node"), F.col("hub.node"))).distinct()


def _second_hub_pairs(rows: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pairs of members with the best connected one outside the root of the best connected of all."""
    weighed = stage(rows.join(degrees, "node").select("key", "root", F.struct("degree", "node", "root").alias("m")), "near-weighed")
    first = stage(weighed.groupBy("key").agg(F.max("m").alias("hub")), "near-hubs")
    # Staged, so that the join can split a hot bucket and the maxima are combined before a shuffle.
    others = stage(weighed.join(first, "key").filter("root != hub.root").select("key", "m"), "near-others")
    second = stage(others.groupBy("key").agg(F.max("m").alias("hub")), "near-hubs")
    pairs = rows.join(second, "key").filter("root != hub.root")
    return pairs.select(*_ordered(F.col("node"), F.col("hub.node"))).distinct()


def _next_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "root")), strict=True):
            out += [sorted((row[1], other[1])) for other in held if other[0] == row[0] and other[2] != row[2]]
            held = [*held[1 - NEIGHBOURS :], row] if NEIGHBOURS > 1 else [row]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _neighbour_pairs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of members that stand next to each other once their bucket is sorted by the sketches after its own."""
    at = F.array_position("keys", F.col("key")).cast("int")
    following = [F.get("keys", (at + i) % F.size("keys")).alias(f"_s{i}") for i in range(4)]
    order = ["key", "_s0", "_s1", "_s2", "_s3", "node"]
    placed = rows.join(known.select("node", "keys"), "node").select("key", *following, "node", "root")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "node", "root").mapInArrow(_next_ones, "a binary, b binary").distinct()


def _marks(labels: np.ndarray) -> np.ndarray:
    """MARK_BITS bits, each the parity of the labelled shingles it stands for, as four words.

    Two texts' bits differ in no more places than one text has shingles that the other lacks.
    """
    odd = np.bincount((labels >> np.uint64(7)).astype(np.int64) % MARK_BITS, minlength=MARK_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8")


def _emit_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            found = [labelled(run) for run in shingles(some.column("text").to_pylist())]
            marks = np.stack([_marks(f) for f in found])
            columns = [some.column("id"), pa.array([len(f) for f in found], pa.int32()), *(pa.array(marks[:, i]) for i in range(4)), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "m0", "m1", "m2", "m3", "shingles"])


def _exact_pairs(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """All pairs of members (node, root) of different roots that can be similar enough, by their rarest shingles.

    Of two texts that share what `least` asks for, each has a shared shingle among its n -
    ceil(least * n) + 1 first ones in any order that holds for all; rarest first, few are shared
    with others. Shingles of one text only take their places in that count and no part in the join.
    Texts meet by shingle and class of length: the shorter of two is in the class of the longer or
    the one below, and its shared shingle stands so early that the rest of it can still be shared.
    The bits of their shingles then rule out most pairs that share a common passage and little else.
    """
    members = stage(members.withColumn("id", F.monotonically_increasing_id()), "near-members")
    told = texts.join(members.select("node", "id"), "node").select("id", "text")
    marks = ["m0", "m1", "m2", "m3"]
    each = stage(told.mapInArrow(_emit_labelled, "id long, n int, m0 long, m1 long, m2 long, m3 long, shingles array<long>"), "near-shingles")
    tokens = each.select("id", F.explode("shingles").alias("token"))
    often = stage(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "near-frequent")
    ranked = tokens.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("m")).join(each.select("id", "n", *marks), "id")
    # Shingles no other member has come before all of m.
    ahead = F.col("n") - F.size("m")
    indexed = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - ahead
    # A little wider than the lengths that can be similar, so that rounding parts none.
    length_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.0001 / least))).cast("int")
    first = ranked.filter(indexed > 0).select("id", "n", length_class.alias("class"), *marks, ahead.alias("ahead"), F.posexplode(F.slice("m", 1, indexed.cast("int"))).alias("i", "t"))
    prefix = stage(first.join(members, "id").select("t.token", "class", "node", "root", "n", (F.col("ahead") + F.col("i")).alias("at"), *marks), "near-prefix")
    half = least / (1 + least)
    sides = {side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "at", *marks)] for side in "ab"}
    shorter = prefix.filter(F.col("at") <= F.col("n") - F.ceil(2 * half * F.col("n") - 1e-9)).select("token", "class", *sides["a"])
    longer = prefix.select("token", "class", *sides["b"]).unionByName(prefix.select("token", (F.col("class") - 1).alias("class"), *sides["b"]))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * half - 1e-9)
    in_order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    # After the first shared shingle no more can be shared than either has left.
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    differ = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in marks), F.lit(0))
    can = in_order & (F.col("root_a") != F.col("root_b")) & (reach >= need) & (differ <= F.col("n_a") + F.col("n_b") - 2 * need)
    return shorter.join(longer, ["token", "class"]).filter(can).select(*_ordered(F.col("node_a"), F.col("node_b"))).distinct()


def links(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roots): the different texts of docs, links between similar ones, and their components.

    nodes: node (MD5 of the text), doc_id (smallest), copies. edges: a, b, similarity: enough of
    them to connect all texts that similar pairs connect. roots: node, root of linked texts.

    Texts meet in buckets of equal sketches. First every member of a bucket is compared with the
    bucket's hub, which joins the large groups. Then members that are still apart are compared
    with each other: all pairs in small buckets; in large ones with a hub outside the first one's
    group, and with their next neighbours when the bucket is sorted by the sketches that follow,
    so that those with most in common stand together. Members of large buckets that are apart even
    then meet by their rarest shingles, which finds all similar pairs among them.
    """
    text = F.col("text")
    rows = docs.filter(text.rlike(r"\S")).select(F.unhex(F.md5(text)).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = rows.mapInArrow(_emit_sketches, "node binary, doc_id long, keys array<long>")
    known = stage(sketched.groupBy("node").agg(F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "near-sketches")
    bands = known.select("node", F.explode("keys").alias("key"))
    often = stage(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-often")
    live = stage(bands.join(often, "key"), "near-buckets")
    degrees = stage(live.groupBy("node").agg(F.sum("n").alias("degree")), "near-degrees")
    known_live = known.join(degrees.select("node"), "node", "left_semi")
    # One row per text: the copy with the smallest doc_id.
    only = known_live.select("node", F.coalesce("doc_id", F.lit(-(2**63))).alias("_d"))
    texts = rows.withColumn("_d", F.coalesce("doc_id", F.lit(-(2**63)))).join(only, ["node", "_d"]).select("node", "text")
    texts = stage(texts.dropDuplicates(["node", "text"]) if _repeats(rows) else texts, "near-texts")

    alone = live.select("key", "node", F.col("node").alias("root"))
    near = stage(_linked(_keyed(_hub_pairs(alone, often.select("key"), degrees), known), texts, least), "near-links")
    roots = stage(components(near), "near-roots")
    apart = live.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    counts = stage(_counts(apart), "near-counts")
    apart = stage(apart.join(counts, "key"), "near-apart")
    members = apart.select("key", "node", "root")
    large = stage(members.join(counts.filter(F.col("n") > SMALL_BUCKET).select("key"), "key"), "near-large")
    rest = _bucket_pairs(members, counts).unionByName(_second_hub_pairs(large, degrees)).unionByName(_neighbour_pairs(large, known))
    late = stage(_linked(_keyed(rest.distinct(), known), texts, least), "near-links")

    joined = near.unionByName(late)
    roots = extended(roots, late)
    apart = large.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = stage(apart, "near-apart")
    members = apart.join(stage(_counts(apart), "near-counts"), "key", "left_semi").select("node", "root").distinct()
    last = stage(_compared(_exact_pairs(members, texts, least), texts, least), "near-links")
    return known.select("node", "doc_id", "copies"), joined.unionByName(last), extended(roots, last)


def representatives(docs: DataFrame, columns: list[str], least: float = SIMILARITY) -> DataFrame:
    """One row of each class of classes(), with doc_id, text and `columns`.

    Of rows that repeat doc_id and text one stays. Null texts are a class each and all stay.
    """
    kept = classes(docs, least, ["text", *columns]).filter("kept").select("doc_id", "text", *columns)
    told = kept.filter("text is not null").withColumn("_node", F.md5("text")).dropDuplicates(["_node"]).drop("_node")
    return told.unionByName(docs.filter("text is null").select(*kept.columns))


def _repeats(rows: DataFrame) -> bool:
    """Whether a text comes twice under one doc_id."""
    return not rows.groupBy("node", "doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def classes(docs: DataFrame, least: float = SIMILARITY, carry: list[str] | None = None) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row: groups of equal and near-equal texts.

    Two texts are linked if at least 0.8 of their 5-word shingles (lower-cased words, occurrences
    counted) can be aligned in order: aligned / (all of both - aligned). Linked texts, and those
    linked through others, form a class; its id is the smallest doc_id (null if it has none).
    kept marks one row of each class: that doc_id's, the first by text where rows repeat.
    Texts of fewer than five words are one shingle. Texts of signs alone form classes of equal ones.
    Rows with null or blank texts are a class each: class_id is their doc_id, and they are kept. An
    empty table gives none.
    Columns named in carry are passed on, others ignored.
    """
    nodes, _, roots = links(docs, least)
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "node"))
    # Staged, so that the join by class reads plain shuffles and a large class can be split.
    grouped = stage(grouped, "near-classes")
    totals = stage(grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), best.alias("best")), "near-totals")
    member = grouped.join(totals, "root").select("node", F.col("doc_id").alias("_first"), "class_id", "class_size", (F.col("best.node") == F.col("node")).alias("_best"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("node"), *(F.col(c).alias(f"_carry_{c}") for c in carry or ()))
    chosen = F.coalesce("_best", F.lit(True)) & (F.coalesce("_first", F.lit(-1)) == F.coalesce("doc_id", F.lit(-1)))
    return rows.join(member, "node", "left").select(
        "doc_id",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(F.col("class_size").isNull(), F.lit(True)).otherwise(chosen).alias("kept"),
        *(F.col(f"_carry_{c}").alias(c) for c in carry or ()),
    )
