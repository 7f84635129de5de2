"""Exact repeats of long byte strings across a corpus, from suffix arrays built by induced sorting.

Every 200-byte window is assigned to one anchor, its leftmost smallest k-gram hash. Equal windows
have equal anchors at equal offsets, so the windows around one anchor k-gram can be judged apart
from all others: anchors seen once are dropped, the others are dealt by k-gram to shards. A shard
sorts the suffixes of its regions by induced sorting, derives the permuted common prefixes, and
flags the windows that share 200 bytes with a neighbour in suffix order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

LENGTH = 200
GRAM = 24
SHARD_BYTES = 4_000_000
#: Regions of one anchor beyond this many bytes are split by the windows' offsets.
GROUP_BYTES = 8_000_000
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)


# --- anchors ---------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes of data (uint8)."""
    values = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * _powers(_UNBASE, len(data)), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _powers(_BASE, len(data) - k + 1)
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the windows of data into runs with one anchor: gram hash, anchor place, first window, windows."""
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    hashes = gram_hashes(data, k)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.arange(len(hashes), dtype=np.uint64) & np.uint64(0xFFFFFFFF))
    place = (_sliding_min(keyed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate(([0], cuts))
    count = np.diff(np.concatenate((first, [len(place)])))
    return hashes[place[first]], place[first], first, count


# --- suffix arrays ---------------------------------------------------------------------------


def _smaller_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is the only smallest."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    rises = s[differs] < s[differs + 1]
    out = np.empty(n, bool)
    out[:-1] = np.repeat(rises, np.diff(np.concatenate(([-1], differs))))
    out[-1] = True
    return out


def _induce(s: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order of s from the order of its leftmost-smaller places; few symbols.

    Works bucket by bucket; what one batch of entries induces is appended to all buckets at once,
    in the order a symbol-by-symbol scan would append it.
    """
    n, sigma = len(s), len(ends)
    starts = np.concatenate(([0], ends[:-1]))
    out = np.full(n, -1, np.int32)

    def append(batch: np.ndarray, edge: np.ndarray, up: bool) -> None:
        before = batch - 1
        before = before[before >= 0]
        before = before[small[before] != up]
        if not len(before):
            return
        symbols = s[before]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        counts = np.bincount(symbols, minlength=sigma)
        nth = np.arange(len(before)) - np.repeat(np.cumsum(counts) - counts, counts)
        if up:
            out[edge[symbols] + nth] = before
            edge += counts
        else:
            out[edge[symbols] - 1 - nth] = before
            edge -= counts

    symbols = s[lms]
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=sigma)
    tails = ends - counts
    out[np.repeat(tails - (np.cumsum(counts) - counts), counts) + np.arange(len(lms))] = lms[order]
    heads = starts.copy()
    for c in range(sigma):
        done = starts[c]
        while done < heads[c]:
            batch, done = out[done : heads[c]], heads[c]
            append(batch, heads, True)
        if tails[c] < ends[c]:
            append(out[tails[c] : ends[c]], heads, True)
    edge = ends.copy()
    for c in range(sigma - 1, -1, -1):
        done = ends[c]
        while edge[c] < done:
            batch, done = out[edge[c] : done][::-1], edge[c]
            append(batch, edge, False)
        if starts[c] < heads[c]:
            append(out[starts[c] : heads[c]][::-1], edge, False)
    return out


def _induce_many(s: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _induce, symbol by symbol, for strings of many symbols."""
    n = len(s)
    previous = np.full(n + 1, -1, np.int64)
    previous[1:n] = s[:-1]
    rising = np.append(False, small)
    rising[0] = False
    larger = np.where(rising, -1, previous)[: n + 1]
    smaller = np.where(rising, previous, -1)
    larger[[0, n]] = smaller[[0, n]] = -1  # the last entry answers for places still open (-1)
    out = [-1] * n
    edge = ends.tolist()
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        edge[c] -= 1
        out[edge[c]] = i
    table, edge = larger.tolist(), [0, *ends[:-1].tolist()]
    for i in out:  # sees what is put further on
        c = table[i]
        if c >= 0:
            e = edge[c]
            out[e] = i - 1
            edge[c] = e + 1
    table, edge = smaller.tolist(), ends.tolist()
    for i in reversed(out):
        c = table[i]
        if c >= 0:
            edge[c] = e = edge[c] - 1
            out[e] = i - 1
    return np.array(out, dtype=np.int32)


def _order_substrings(s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the leftmost-smaller substrings of a string of many symbols, and whether each equals the one before.

    One symbol a round; a substring that has ended sorts after those that go on.
    """
    size = np.diff(np.append(lms, len(s) - 1)) + 1
    begin = lms.astype(np.int64)
    group = np.zeros(len(lms), np.int64)
    open_ = np.arange(len(lms))
    over = int(s.max()) + 1
    step = 0
    while len(open_):
        symbol = np.where(size[open_] > step, s[np.minimum(begin[open_] + step, len(s) - 1)], over)
        order = np.lexsort((symbol, group[open_]))
        g, c = group[open_][order], symbol[order]
        fresh = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        within = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        sizes = np.diff(np.append(fresh, len(g)))
        # A group is numbered by its first member's place in the whole order.
        group[open_[order]] = np.repeat(g[fresh] + within[fresh], sizes)
        again = np.repeat(sizes > 1, sizes) & (c != over)
        open_ = open_[order][again]
        step += 1
    order = np.argsort(group, kind="stable")
    return order, np.concatenate(([False], group[order][1:] == group[order][:-1]))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (integers from 0 on; the last one is the only 0)."""
    n = len(s)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    small = _smaller_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    sigma = int(s.max()) + 1
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    few = sigma <= 512
    if few:
        s = s.astype(np.uint16)
    if len(lms) > 1:
        if few:
            rank = np.full(n, -1, np.int32)
            rank[lms] = np.arange(len(lms), dtype=np.int32)
            nth = rank[_induce(s, small, ends, lms)]
            nth = nth[nth >= 0]
            same = _equal_neighbours(s, lms, nth)
        else:
            nth, same = _order_substrings(s, lms)
        names = np.cumsum(~same) - 1
        reduced = np.empty(len(lms), np.int64)
        reduced[nth] = names
        lms = lms[suffix_array(reduced) if names[-1] + 1 < len(lms) else nth]
    return (_induce if few else _induce_many)(s, small, ends, lms)


def _equal_neighbours(s: np.ndarray, lms: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Of leftmost-smaller substrings in order: whether each equals the one before."""
    begin, size = lms[nth].astype(np.int64), np.diff(np.append(lms, len(s) - 1))[nth] + 1
    same = np.concatenate(([False], size[1:] == size[:-1]))
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        differ = s[begin[open_] + step] != s[begin[open_ - 1] + step]
        same[open_[differ]] = False
        step += 1
        open_ = open_[~differ]
        open_ = open_[size[open_] > step]
    return same


def common_prefixes(data: np.ndarray, order: np.ndarray, left: np.ndarray) -> np.ndarray:
    """PLCP: of each suffix with the one before it in order, at most `left` bytes of either.

    Where the bytes before both suffixes are equal too, the value is one less than that of the
    suffix one place to the left; only the other places are compared, eight bytes at a time.
    """
    n = len(data)
    eights = np.ndarray((n,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (left[1:] > 0) & (left[:-1] > 0)
    at = np.flatnonzero(reducible)
    reducible[at] = (data[at - 1] == data[before[at] - 1]) & (left[before[at - 1]] > 0)
    value = np.zeros(n, np.int64)
    at = np.flatnonzero(~reducible & (before >= 0))
    limit = np.minimum(left[at], left[before[at]])
    step = 0
    while len(at):
        differ = eights[at + step] ^ eights[before[at] + step]
        end = differ != 0
        # The lowest set bit lies in the first byte that differs.
        low = differ[end] & (~differ[end] + np.uint64(1))
        value[at[end]] = np.minimum(step + (np.frexp(low.astype(np.float64))[1] - 1) // 8, limit[end])
        at, limit = at[~end], limit[~end]
        step += 8
        full = limit <= step
        value[at[full]] = limit[full]
        at, limit = at[~full], limit[~full]
    head = np.maximum.accumulate(np.where(reducible, 0, own))
    return np.maximum(value[head] - (own - head), 0)


def repeated_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """Per region, whether each of its windows of `length` bytes is also elsewhere in the regions."""
    sizes = np.array([len(r) for r in regions], dtype=np.int64)
    data = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    s = np.empty(len(data) + 1, np.int64)
    s[:-1] = data.astype(np.int64) + 2
    stops = np.cumsum(sizes + 1) - 1
    s[stops] = 1
    s[-1] = 0
    left = np.zeros(len(s), np.int64)
    left[: len(data)] = np.repeat(stops, sizes + 1) - np.arange(len(data))
    order = suffix_array(s)
    shared = common_prefixes(np.append(data, np.uint8(0)), order, left)
    hit = shared >= length
    flagged = hit.copy()
    later = np.flatnonzero(hit[order])
    flagged[order[later - 1]] = True
    begins = stops - sizes
    return [flagged[b : b + max(0, n - length + 1)] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


# --- the corpus ------------------------------------------------------------------------------

SEGMENT = "f long, rid long, id long, at long"
ITEM = "key long, rid long, copies long, lo int, hi int, a int, n int, region binary"
SPANS = "array<struct<first:int,last:int>>"
CHUNK = 1 << 20


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _pack(first, anchor, count):
    """First window (48 bits), anchor's distance from it (8 bits), windows (8 bits)."""
    return (first << 16) | (anchor << 8) | count


def _emit_segments(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, rid, ids, at = [], [], [], []
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = (text or "").encode()
                for base in range(0, len(whole) - length + 1, CHUNK):
                    part = whole[base : base + CHUNK + length - 1]
                    grams, place, first, count = segments(np.frombuffer(part, np.uint8), length, k)
                    f.append(grams.view(np.int64))
                    stops = (first + count + length - 1).tolist()
                    rid.append(np.array([xxhash.xxh3_64_intdigest(part[i:j]) for i, j in zip(first.tolist(), stops, strict=True)], np.uint64).view(np.int64))
                    ids.append(np.full(len(first), doc, np.int64))
                    at.append(_pack(first + base, place - first, count))
            if f:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (f, rid, ids, at)], names=["f", "rid", "id", "at"])

    return run


def _emit_regions(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "rid", "copies", "lo", "hi", "a", "n", "region"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()]
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                whole = text.encode()
                for w in wanted:
                    first, anchor, count = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                    rows.append((w["f"], w["rid"], w["copies"], 0, reach, anchor, count, whole[first : first + count + length - 1]))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _split(length: int):
    """Split regions by the windows' distance from the anchor, and key each part by the bytes all its windows share."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                middle = (r.lo + r.hi) // 2
                for lo, hi in ((r.lo, middle), (middle, r.hi)):
                    first, last = max(0, r.a - hi + 1), min(r.n - 1, r.a - lo)
                    if first > last:
                        continue
                    region = r.region[first : last + length]
                    shared = r.region[r.a - lo : r.a - hi + 1 + length]
                    key = xxhash.xxh3_64(shared, seed=r.key & (2**64 - 1))
                    key.update(lo.to_bytes(4, "little") + hi.to_bytes(4, "little"))
                    rid = _signed(xxhash.xxh3_64_intdigest(region))
                    rows.append((r.key, r.rid, first, _signed(key.intdigest()), rid, r.copies, lo, hi, r.a - first, last - first + 1, region))
            yield pd.DataFrame(rows, columns=["up_key", "up_rid", "shift", "key", "rid", "copies", "lo", "hi", "a", "n", "region"])

    return run


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"first": int(i), "last": int(j) - 1} for i, j in zip(edges[::2], edges[1::2], strict=True)]


def _judge_shard(length: int, most: int):
    """Windows repeated within each key's regions; keys are put together up to `most` bytes."""

    def judged(regions: dict[tuple[int, int], bytes]):
        for (key, rid), flags in zip(regions, repeated_windows(list(regions.values()), length), strict=True):
            if flags.any():
                yield key, rid, _runs(flags)

    def run(shard):
        import pandas as pd

        out, held, size, last = [], {}, 0, None
        shard = shard.sort_values(["key", "rid"], ignore_index=True)
        for key, rid, region in zip(shard["key"].tolist(), shard["rid"].tolist(), shard["region"], strict=True):
            if key != last and size > most:
                out.extend(judged(held))
                held, size = {}, 0
            last = key
            if (key, rid) not in held:
                held[key, rid] = region
                size += len(region)
        if held:
            out.extend(judged(held))
        return pd.DataFrame(out, columns=["key", "rid", "spans"])

    return run


def with_identity(docs: DataFrame) -> DataFrame:
    """docs plus _id, a 64-bit hash of doc_id and text."""
    return docs.withColumn("_id", F.xxhash64("doc_id", "text"))


def repeated_spans(
    docs: DataFrame,
    length: int = LENGTH,
    k: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """id, spans: first and last byte of every run of windows of `length` bytes that also start elsewhere.

    docs: _id and text. Runs of one document may touch or overlap.
    """
    reach = length - k + 1
    assert 0 < reach < 256
    segs = docs.select("_id", "text").filter(F.octet_length("text") >= length).mapInArrow(_emit_segments(length, k), SEGMENT)
    segs = stage(segs, "suffix-segments")
    # Aggregated sides are staged, so that the joins read plain shuffles and a hot anchor can be split.
    often = stage(segs.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f"), "suffix-often")
    members = stage(segs.join(often, "f"), "suffix-members")
    found = stage(members.groupBy("f", "rid").agg(F.count("*").alias("copies"), F.min(F.struct("id", "at")).alias("rep")), "suffix-found")
    kinds = stage(found.groupBy("f").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("f"), "suffix-kinds")
    mixed = found.join(kinds, "f").select("rep.id", F.struct("f", "rid", "copies", "rep.at").alias("w"))
    wanted = mixed.groupBy("id").agg(F.collect_list("w").alias("wanted"))
    regions = docs.select(F.col("_id").alias("id"), "text").join(wanted, "id").select("text", "wanted").mapInArrow(_emit_regions(length, reach), ITEM)
    items = stage(regions, "suffix-regions")

    all_of = lambda n: F.array(F.struct(F.lit(0).alias("first"), (n - 1).cast("int").alias("last")))
    windows = F.col("rep.at").bitwiseAND(F.lit(255))
    results = [found.filter("copies > 1").select("f", "rid", all_of(windows).alias("spans"))]
    roots = None
    while True:
        sizes = items.groupBy("key").agg(F.sum(F.length("region")).alias("bytes"), F.count("*").alias("kinds"), F.max(F.expr("hi - lo")).alias("reach"))
        sizes = stage(sizes.filter("kinds > 1"), "suffix-sizes")
        total = sizes.agg(F.sum("bytes"), F.count_if(F.expr(f"bytes > {group_bytes} and reach > 1"))).first()
        large = sizes.filter(f"bytes > {group_bytes} and reach > 1").select("key")
        shards = max(1, -(-(total[0] or 0) // shard_bytes))
        fit = items.join(sizes.filter(f"not (bytes > {group_bytes} and reach > 1)").select("key"), "key")
        judged = fit.select("key", "rid", "region", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
        judged = judged.groupBy("shard").applyInPandas(_judge_shard(length, shard_bytes // 2), f"key long, rid long, spans {SPANS}")
        whole = items.filter("copies > 1").select("key", "rid", all_of(F.col("n")).alias("spans"))
        if roots is None:
            results.append(judged.select(F.col("key").alias("f"), "rid", "spans"))
        else:
            moved = lambda x: F.struct((x["first"] + F.col("shift")).alias("first"), (x["last"] + F.col("shift")).alias("last"))
            back = judged.unionByName(whole).join(roots, ["key", "rid"])
            results.append(back.select("f", F.col("root_rid").alias("rid"), F.transform("spans", moved).alias("spans")))
        if not total[1]:
            break
        parts = stage(items.join(large, "key").mapInPandas(_split(length), f"up_key long, up_rid long, shift int, {ITEM}"), "suffix-split")
        step = parts.select("up_key", "up_rid", "shift", "key", "rid").distinct()
        if roots is None:
            roots = step.select(F.col("up_key").alias("f"), F.col("up_rid").alias("root_rid"), "shift", "key", "rid")
        else:
            up = roots.select("f", "root_rid", F.col("shift").alias("_shift"), F.col("key").alias("up_key"), F.col("rid").alias("up_rid"))
            roots = step.join(up, ["up_key", "up_rid"]).select("f", "root_rid", (F.col("shift") + F.col("_shift")).alias("shift"), "key", "rid")
        roots = stage(roots, "suffix-roots")
        once = F.first(F.struct("lo", "hi", "a", "n", "region")).alias("x")
        items = stage(parts.groupBy("key", "rid").agg(F.sum("copies").alias("copies"), once).select("key", "rid", "copies", "x.*"), "suffix-regions")
    flagged = results[0]
    for more in results[1:]:
        flagged = flagged.unionByName(more)
    first = F.shiftright("at", 16)
    moved = lambda x: F.struct((x["first"] + first).alias("first"), (x["last"] + first + (length - 1)).alias("last"))
    return members.join(flagged, ["f", "rid"]).select("id", F.explode(F.transform("spans", moved)).alias("span")).groupBy("id").agg(F.collect_set("span").alias("spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            whole, parts, at, count = (text or "").encode(), [], 0, 0
            for first, last in sorted((s["first"], s["last"]) for s in found or ()):
                if first > at or not count:
                    count += 1
                    parts.append(whole[at:first])
                at = max(at, last + 1)
            parts.append(whole[at:])
            kept.append(b"".join(parts))
            removed.append(len(whole) - len(kept[-1]))
            spans.append(count)
        rest = [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.add(rest[1], pa.array([len(k) for k in kept], pa.int64())), rest[1], rest[2], rest[0]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each text as UTF-8 without the bytes of repeated strings.

    A byte goes if it lies in a string of `length` bytes (200) that also starts at another place of
    any text, the same one included; all judged on the input. Spans that touch count as one.
    Null texts are empty. Repeated rows are documents of their own, so their long texts repeat each
    other. Texts shorter than `length` are left alone. kept may break a letter of several bytes. An
    empty table gives no rows; other columns are ignored. options: those of repeated_spans.
    """
    known = with_identity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = repeated_spans(known, **options).withColumnRenamed("id", "_id")
    return (
        known.join(spans, "_id", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def digests(docs: DataFrame, **options) -> DataFrame:
    """remove_repeats with the SHA-256 of what is kept in place of the bytes."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
