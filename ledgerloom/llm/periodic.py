"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q, at least three periods and 24 words long, that
no neighbouring word extends. Texts are arrays of word numbers. At each dyadic scale t, a hash of
the next t words selects positions that depend on 2 t words alone; a run of a period from 2 t to
4 t repeats such a position one period on, with equal words around it, so equal contexts propose
the periods. Positions inside highly periodic regions (a period of at most t / 3) are left out at
that scale: their runs were found at smaller scales, the smallest ones by comparing words directly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs have at least so many words and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Smaller periods are found by comparing each word with the one a period on.
DIRECT = 8
#: Texts are searched together up to so many words; a longer text is searched alone.
GROUP_WORDS = 1_000_000
COLLAPSED = "doc_id long, text string, runs array<struct<start:long,length:long,period:long>>"
DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice as many words, from hashes of `size` words."""
    return _mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])


def _windows_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` (a power of two) plus one values."""
    low, size = h, 1
    while size < width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:-1], low[1:])


def _stretch(words: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest first..end around `at` in which words d apart are identical, as far as words[at] agrees."""
    n, size, end = len(words), 64, at
    while end + d < n:
        m = min(size, n - d - end)
        differ = np.flatnonzero(words[end : end + m] != words[end + d : end + d + m])
        if len(differ):
            end += int(differ[0])
            break
        end, size = end + m, size * 2
    size, first = 64, at
    while first > 0:
        m = min(size, first)
        differ = np.flatnonzero(words[first - m : first] != words[first - m + d : first + d])
        if len(differ):
            first -= m - 1 - int(differ[-1])
            break
        first, size = first - m, size * 2
    return first, end + d


class Search:
    """All runs of at least three periods in an array of word numbers."""

    def __init__(self, words: np.ndarray):
        self.words = words
        #: first, end -> smallest period
        self.found: dict[tuple[int, int], int] = {}

    def _keep(self, first: int, end: int, period: int) -> None:
        if end - first >= LEAST_PERIODS * period:
            self.found[first, end] = min(period, self.found.get((first, end), period))

    def direct(self) -> None:
        """Runs of the periods below DIRECT."""
        for q in range(1, min(DIRECT, len(self.words) // LEAST_PERIODS + 1)):
            same = np.concatenate(([False], self.words[:-q] == self.words[q:], [False])).view(np.int8)
            edges = np.flatnonzero(np.diff(same))
            starts, ends = edges[::2], edges[1::2]
            long = ends - starts >= (LEAST_PERIODS - 1) * q
            for first, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                self._keep(first, end + q, q)

    def _highly_periodic(self, t: int, n: int, offset: int) -> np.ndarray:
        """Marks the first n positions after offset whose t words have a period of at most t / 3."""
        change = np.zeros(n + 1, np.int32)
        for (first, end), period in self.found.items():
            if LEAST_PERIODS * period <= t <= end - first and end - t >= offset:
                change[max(first - offset, 0)] += 1
                change[min(end - t + 1 - offset, n)] -= 1
        return np.cumsum(change[:n]) > 0

    def scale(self, t: int, h: np.ndarray, offset: int) -> None:
        """Runs of the periods from 2 t to 4 t; h: hashes of the t words at each position after offset."""
        none = np.uint64(2**64 - 1)
        ranks = np.where(self._highly_periodic(t, len(h), offset), none, h)
        # A position is in the set if it, or the one t words on, is the first choice of the t + 1 from it on.
        least = _windows_min(ranks, t)
        chosen = ((least == ranks[: len(least)]) | (least == ranks[t:])) & (least != none)
        at = np.flatnonzero(chosen)
        context = _joined(h, t)[at]
        order = np.lexsort((at, context))
        at, context = at[order], context[order]
        firsts, gaps, k = [], [], 1
        # Equal contexts outside periodic regions are more than t / 3 apart: few lie within 4 t.
        live = np.arange(len(at))
        while True:
            live = live[live + k < len(at)]
            live = live[context[live] == context[live + k]]
            gap = at[live + k] - at[live]
            live, gap = live[gap < 4 * t], gap[gap < 4 * t]
            if not len(live):
                break
            near = gap >= 2 * t
            firsts.append(at[live[near]])
            gaps.append(gap[near])
            k += 1
        if not firsts:
            return
        first, gap = np.concatenate(firsts), np.concatenate(gaps)
        # Two periods more than a context must agree, so t words do on one side of it.
        after = first + 2 * t
        ahead = np.zeros(len(first), bool)
        held = after + gap < len(h)
        ahead[held] = h[after[held]] == h[after[held] + gap[held]]
        held = (first >= t) & ~ahead
        ahead[held] = h[first[held] - t] == h[first[held] - t + gap[held]]
        first, gap = first[ahead], gap[ahead]
        order = np.lexsort((first, gap))
        seen_gap = seen_end = -1
        for d, a in zip(gap[order].tolist(), first[order].tolist(), strict=True):
            if d == seen_gap and a + offset + d < seen_end:
                continue
            begin, end = _stretch(self.words, a + offset, d)
            seen_gap, seen_end = d, end
            self._keep(begin, end, d)


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per text (word numbers from 0): its runs as (start, length, period), by start, then period.

    The texts stand in one array, shortest first, with a number of its own after each, which no
    run can hold; a scale looks at the texts that are long enough for its periods only.
    """
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    sizes = np.array([len(texts[i]) + 1 for i in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    words = np.empty(starts[-1], np.int64)
    for k, i in enumerate(order):
        words[starts[k] : starts[k + 1] - 1] = texts[i]
        words[starts[k + 1] - 1] = -1 - k
    search = Search(words)
    search.direct()
    t, offset = DIRECT // 2, 0
    h = _mix(words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    size = 1
    while True:
        begin = int(np.searchsorted(sizes, 2 * t * LEAST_PERIODS + 1))
        if begin == len(sizes):
            break
        h, offset = h[starts[begin] - offset :], int(starts[begin])
        while size < t:
            h, size = _joined(h, size), size * 2
        search.scale(t, h, offset)
        t *= 2
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (first, end), period in search.found.items():
        if end - first >= LEAST_WORDS:
            k = int(np.searchsorted(starts, first, side="right")) - 1
            runs[order[k]].append((first - int(starts[k]), end - first, period))
    for some in runs:
        some.sort(key=lambda r: (r[0], r[2]))
    return runs


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_copy(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places the words of the changed text come from, for the tenth of texts that are changed; else None.

    With h = crc32 of the decimal doc_id and g = h // 10, texts with h % 10 = 0 repeat the p words
    from word a = g % n on, p = 1 + (n - a) // (3 + g % 8).
    """
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and where each text starts in it."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(np.asarray(real))))
    offsets = np.asarray(parts.offsets).astype(np.int64)
    return flat.filter(real), before[offsets - offsets[0]]


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows that hold up to GROUP_WORDS words, or one row."""
    first, words = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if words and words + n > GROUP_WORDS:
            yield first, i
            first, words = i, 0
        words += n
    if first < len(lengths):
        yield first, len(lengths)


def _texts_with_runs(ids: list[int | None], texts: pa.Array, changed: bool) -> Iterator[tuple[int | None, list[tuple[int, int, int]], pa.Scalar]]:
    """doc_id, runs and the words kept, joined by one space, of every text."""
    flat, bounds = _cut(texts)
    coded = flat.dictionary_encode()
    numbers = np.asarray(coded.indices).astype(np.int64)
    words = coded.dictionary.cast(pa.large_string())
    each = []
    for doc, lo, hi in zip(ids, bounds[:-1], bounds[1:], strict=True):
        own = numbers[lo:hi]
        copied = periodic_copy(doc, len(own)) if changed else None
        each.append(own if copied is None else own[copied])
    found = find_runs(each)
    kept = [own[kept_words(len(own), runs)] if runs else own for own, runs in zip(each, found, strict=True)]
    ends = np.concatenate(([0], np.cumsum([len(k) for k in kept])))
    every = words.take(pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), every), pa.scalar(" ", pa.large_string()))
    yield from zip(ids, found, joined, strict=True)


def _rows(batches: Iterator[pa.RecordBatch], changed: bool):
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # Bytes tell the words nearly enough: a word takes about six, and two at least.
        for first, end in _groups(np.asarray(pc.binary_length(texts.fill_null(""))).astype(np.int64) // 4):
            yield list(_texts_with_runs(ids[first:end], texts.slice(first, end - first), changed))


def _emit_digests(changed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, changed):
            out = []
            for doc, runs, text in rows:
                # The greatest exact ratio; ties: smallest start, then period.
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
                told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out.append((
                    doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text.as_buffer() or b"").hexdigest(),
                ))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def _emit_collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for rows in _rows(batches, changed=False):
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for _, found, _ in rows]
        columns = [pa.array([doc for doc, _, _ in rows], pa.int64()), pa.array([t.as_py() for _, _, t in rows], pa.string()), pa.array(runs, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "runs"])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text (words outside runs and the first period of each run, joined by one space), runs; no shuffle.

    runs: start (number of the first word), length and period in words, by start, then period.
    Words are what blanks and line ends separate. Null and empty texts, and texts without words, give
    an empty text and no runs. Null and repeated doc_ids keep their rows. Texts of any length are
    searched whole. Other columns are ignored. An empty table gives none.
    """
    return _documents(docs).mapInArrow(_emit_collapsed, COLLAPSED)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most periods and digests of all runs and of the collapsed text; no shuffle.

    A tenth of the texts, by doc_id, is made periodic first (see periodic_copy); those without a
    doc_id are not. start, length, period and exponent_milli are null where there is no run. Cases as in collapse.
    """
    return _documents(docs).mapInArrow(_emit_digests(True), DIGESTS)
