"""Spelling variants grouped: words one edit apart, found by pivotal grams.

Of a word's bigrams the rarest three make up its gram prefix; two disjoint ones among them, chosen by
dynamic programming for the smallest total frequency, are its pivots. One edit leaves a pivot whole,
and of two near words one has that pivot in the other's gram prefix. What lies on the outer side of
that pivot is untouched too, so it stands at the same distance from that end of both words: the
pivot, its place and the text up to that end are one join key. The rest of the word joins it
with one letter left out, so common keys stay as selective as rare ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

#: Words have at least so many letters and occurrences; a form is so many times as frequent as its variant.
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
#: Of the runs, those whose hash this number divides lose a letter.
CHANGED = 31
#: Grams are this long; near words differ by one edit, so gram prefixes hold GRAM + 1 grams.
GRAM = 2
#: Different words a task counts before it hands them on.
HELD_WORDS = 100_000
#: Keys of one batch of words that are made together.
KEY_ROWS = 200_000

_LETTERS = r"[A-Za-zÀ-ÿ]"
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- words -----------------------------------------------------------------------------------


def text_words(doc_id: int | None, text: str, changed: bool, pattern: re.Pattern) -> Counter:
    """Words of a text with at least LEAST_LETTERS letters, and how often each occurs.

    Only A-Z are lower-cased. With `changed`, runs whose crc32 of "<doc_id>:<run>" CHANGED divides
    lose the letter at that number modulo their length; without a doc_id none does.
    """
    found = Counter(pattern.findall(text.encode().lower().decode()))
    if not changed or doc_id is None:
        return found
    begun = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for word, n in found.items():
        h = zlib.crc32(word.encode(), begun)
        if h % CHANGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LETTERS:
                continue
        out[word] += n
    return out


def _emit_words(changed: bool):
    pattern = re.compile(f"{_LETTERS}{{{LEAST_LETTERS},}}")

    def told(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    for word, n in text_words(doc, text, changed, pattern).items():
                        counts[word] += n
                    if len(counts) > HELD_WORDS:
                        yield told(counts)
                        counts = Counter()
        yield told(counts)

    return run


def word_counts(docs: DataFrame, changed: bool = False) -> DataFrame:
    """word, n: words of all whole texts with at least LEAST_COUNT occurrences overall."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_emit_words(changed), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


# --- pivots ----------------------------------------------------------------------------------


def pivots(word: str, rank: dict[str, int], weight: dict[str, int]) -> tuple[int, int, list[int], list[int]]:
    """(left pivot, right pivot, left prefix places, right prefix places) of a word.

    The gram prefix is all grams that rank no later than the third of the word's grams in rank. A
    gram that recurs counts at its first place for the left side and at its last for the right side:
    text that is untouched up to there keeps it first, or last. The pivots are a left and a right
    place without a common letter of the smallest total weight, found in one pass over the
    places that keeps the best left pivot ending so far.
    """
    grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
    ranks = [rank[g] for g in grams]
    last = sorted(ranks)[GRAM]
    lefts: dict[str, int] = {}
    rights: dict[str, int] = {}
    for i, g in enumerate(grams):
        if ranks[i] <= last:
            lefts.setdefault(g, i)
            rights[g] = i
    left, right = sorted(lefts.values()), sorted(rights.values())
    best = chosen = None
    at = 0
    for b in right:
        while at < len(left) and left[at] + GRAM <= b:
            cost = weight[grams[left[at]]]
            if best is None or cost < best[0]:
                best = cost, left[at]
            at += 1
        if best and (chosen is None or best[0] + weight[grams[b]] < chosen[0]):
            chosen = best[0] + weight[grams[b]], best[1], b
    return chosen[1], chosen[2], left, right


def _emit_pivots(frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = frequency.value
        rank = {g: i for i, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}
        for batch in batches:
            words = batch.column("word").to_pylist()
            found = [pivots(w, rank, weight) for w in words]
            sides = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            columns = [batch.column("id"), batch.column("word"), batch.column("n"), *sides]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "word", "n", "left", "right", "lefts", "rights"])

    return run


class _Hashes:
    """Hashes of stretches of letters in an array of code points."""

    def __init__(self, letters: np.ndarray):
        n = len(letters) + 1
        self.up, self.down = self._powers(_BASE, n), self._powers(_UNBASE, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_mix(letters.astype(np.uint64) + np.uint64(1)) * self.up[:-1], out=self.sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[first]) * self.down[first]

    def without(self, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of first..end-1 with the letter at `at` left out."""
        return self.of(first, at) + self.up[at - first] * self.of(at + 1, end)


def side_keys(words: list[str], which: np.ndarray, places: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of grams at `places` of the words `which`, with the text to their left (or right) whole.

    key, word, letter: one row for the rest of the word and one for it without each of its letters;
    letter is the place of the letter left out, -1 for none.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate(([0], ends[:-1]))
    hashes = _Hashes(letters)
    start, end = starts[which], ends[which]
    cut = start + places + np.where(left, GRAM, 0)
    whole = _mix(hashes.of(np.where(left, start, cut), np.where(left, cut, end)) + np.where(left, cut - start, cut - end).astype(np.uint64))
    first, stop = np.where(left, cut, start), np.where(left, end, cut)
    sizes = stop - first + 1
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), KEY_ROWS), side="left")
    for lo, hi in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        size = sizes[lo:hi]
        row = np.repeat(np.arange(lo, hi), size)
        letter = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        none = letter == sizes[row] - 1
        at = first[row] + letter
        rest = np.empty(len(row), np.uint64)
        rest[none] = hashes.of(first[row[none]], stop[row[none]])
        some = ~none
        rest[some] = hashes.without(first[row[some]], stop[row[some]], at[some])
        letter[none] = -1
        key = _mix(whole[row] ^ _mix(rest + (sizes[row] - some).astype(np.uint64)))
        yield key.view(np.int64), which[row], letter


def _emit_keys(of_pivots: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = np.asarray(batch.column("id")), batch.column("word").to_pylist()
            if of_pivots:
                places = [np.asarray(batch.column(c)) for c in ("left", "right")]
                which = [np.arange(len(words))] * 2
            else:
                lists = [batch.column(c) for c in ("lefts", "rights")]
                places = [np.asarray(x.flatten()) for x in lists]
                which = [np.repeat(np.arange(len(words)), np.diff(np.asarray(x.offsets))) for x in lists]
            left = np.repeat([True, False], [len(p) for p in places])
            for key, word, letter in side_keys(words, np.concatenate(which), np.concatenate(places).astype(np.int64), left):
                columns = [pa.array(key), pa.array(ids[word]), pa.array(letter.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "letter"])

    return run


def near_words(counts: DataFrame) -> DataFrame:
    """word, n, other, other_n: all pairs of words exactly one edit apart, in both orders.

    counts: word, n. Words of fewer than GRAM + 2 letters take no part.
    """
    grams = counts.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(GRAM))))).alias("gram"))
    # At most one row for each pair of letters: 90 letters make 8,100.
    frequency = counts.sparkSession.sparkContext.broadcast({r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()})
    numbered = stage(counts.filter(F.length("word") >= GRAM + 2).withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    words = stage(numbered.mapInArrow(_emit_pivots(frequency), "id long, word string, n long, left int, right int, lefts array<int>, rights array<int>"), "spelling-pivots")
    schema = "key long, id long, letter int"
    index = words.mapInArrow(_emit_keys(True), schema).select("key", F.col("id").alias("a"), F.col("letter").alias("letter_a"))
    other = words.mapInArrow(_emit_keys(False), schema).select("key", F.col("id").alias("b"), F.col("letter").alias("letter_b"))
    # The letter left out is the same place of both words, or one word has no letter left out.
    one_edit = (F.col("letter_a") == F.col("letter_b")) | ((F.col("letter_a") < 0) != (F.col("letter_b") < 0))
    met = index.join(other, "key").filter(one_edit & (F.col("a") != F.col("b")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    told = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a")), "a").join(
        words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b")), "b"
    )
    true = stage(told.filter(F.levenshtein("word_a", "word_b", 1) == 1).select("word_a", "n_a", "word_b", "n_b"), "spelling-near")
    return true.toDF("word", "n", "other", "other_n").unionByName(true.toDF("other", "other_n", "word", "n"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where following links (word, form) ends. Chains double, so few rounds are needed."""
    now = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of counts (word, n: different words, not null).

    form: the near word (one letter inserted, deleted or replaced) of the largest n, ties the smallest
    in code-point order, if it is at least `ratio` times as frequent; else null. root: where
    forms end, the word itself without a form. An empty table gives none.
    """
    counts = stage(counts.select("word", "n"), "spelling-counts")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    near = near_words(counts).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    often = -F.col("best.less")
    enough = often >= ratio * F.col("n")
    near = stage(near.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, often).alias("form_n")), "spelling-forms")
    roots = _roots(near.filter("form is not null"))
    return counts.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def variants(docs: DataFrame, changed: bool = False) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs; see group and word_counts.

    Words are maximal runs of Latin letters of the first two Unicode blocks; only A-Z are lower-cased.
    Null and empty texts have none. Texts and words of any length are read whole. Repeated rows count
    each. With `changed`, some runs lose a letter by their doc_id (see text_words). Other columns are
    ignored. An empty table gives none.
    """
    return group(word_counts(docs, changed))
