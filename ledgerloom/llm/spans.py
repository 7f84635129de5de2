"""Repeated passages removed by hashing sliding runs of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

SENTENCES = 3
LEAST_WORDS = 25
#: Sentences of more words are cut to pieces.
LONGEST_SENTENCE = 16
#: One row per document: ends of its sentences in letters, and its runs: 96 bits of their hash, first << 32 | end.
CUT = "doc_id long, id long, row long, ends array<int>, h array<long>, c array<int>, at array<long>"

#: Long sentences are cut before words whose hash is the smallest among so many on either side.
WINDOW = 3
#: Scripts written without blanks: every character counts as a word.
_SOLID = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

#: What may end a sentence. Signs between letters are read as a whole too, so long rows of them cost one look.
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(\s+|\Z)?|[。！？｡]+[\"'”’」』）]*\s*|\n\s*")
_SIGN = frozenset(".!?…")
_WORD = re.compile(rf"[{_SOLID}]\s*|[^\s{_SOLID}]+\s*")
_ANY_SOLID = re.compile(f"[{_SOLID}]")


#: Stands for a sentence without words.
_WORDLESS = b"\0" * 16


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.strip().lower())


def _pieces(sentence: str) -> Iterator[str]:
    """A long sentence in pieces that depend on the words around each cut, not on where the sentence starts.

    Where that leaves more than twice LONGEST_SENTENCE words, as in words that recur at once, the
    smallest hash of the second half of LONGEST_SENTENCE words is next.
    """
    blank = len(sentence) - len(sentence.lstrip())
    words = _WORD.findall(sentence, blank)
    hashes = [*map(_word_hash, words)]
    cuts = [0]
    inner = [
        i
        for i in range(WINDOW, len(words) - WINDOW)
        if hashes[i - 1] > hashes[i] <= hashes[i + 1] and hashes[i] < min(hashes[i - WINDOW : i]) and hashes[i] <= min(hashes[i + 1 : i + 1 + WINDOW])
    ]
    for cut in [*inner, len(words)]:
        while cut - cuts[-1] > 2 * LONGEST_SENTENCE:
            half, full = cuts[-1] + LONGEST_SENTENCE // 2 + 1, cuts[-1] + LONGEST_SENTENCE
            cuts.append(min(range(half, full + 1), key=lambda i: (hashes[i], -i)))
        cuts.append(cut)
    for first, end in pairwise(cuts):
        yield sentence[:blank] * (first == 0) + "".join(words[first:end])


def _ends(text: str) -> Iterator[int]:
    """Where sentences end, with the white space after them."""
    for m in _END.finditer(text):
        if m.group(1) is not None or text[m.start()] not in _SIGN:
            yield m.end()


def _units(text: str) -> Iterator[tuple[str, int, list[str]]]:
    """Sentences, or pieces of long ones: text, number of words, lower-cased words between blanks."""
    solid = _ANY_SOLID.search(text)
    at = 0
    for end in (*_ends(text), len(text)):
        if end == at:
            continue
        part, at = text[at:end], end
        words = part.lower().split()
        n = len(_WORD.findall(part)) if solid else len(words)
        if n <= LONGEST_SENTENCE:
            yield part, n, words
        else:
            for piece in _pieces(part):
                own = piece.lower().split()
                yield piece, len(_WORD.findall(piece)) if solid else len(own), own


def sentences(text: str) -> list[str]:
    """Sentences of a text with the white space after them; joined they are the text.

    Line ends, . ! ? … before white space and 。！？ end a sentence; long sentences are cut to pieces.
    """
    return [part for part, _, _ in _units(text)]


def _run_bounds(counts: list[int], sentences_: int, least_words: int) -> list[tuple[int, int]]:
    """first, end of the shortest runs from every sentence on and up to every sentence, by words in each."""
    total = [0, *accumulate(counts)]
    found, end, start = set(), 0, 0
    for first in range(len(counts)):
        while end < len(counts) and (end - first < sentences_ or total[end] - total[first] < least_words):
            end += 1
        if end - first < sentences_ or total[end] - total[first] < least_words:
            break
        found.add((first, end))
    for last in range(sentences_, len(counts) + 1):
        while last - start > sentences_ and total[last] - total[start + 1] >= least_words:
            start += 1
        if total[last] - total[start] >= least_words:
            found.add((start, last))
    return sorted(found)


def runs(units: list[str], sentences_: int = SENTENCES, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, str]]:
    """The shortest runs of enough sentences and words from every sentence on and up to every sentence: first, end, words compared.

    They cover every sentence of any longer run. Case and white space don't count. No run starts
    with a sentence without words.
    """
    words = [u.lower().split() for u in units]
    for first, end in _run_bounds([len(_WORD.findall(u)) for u in units], sentences_, least_words):
        if words[first]:
            yield first, end, "\n".join(" ".join(w) for w in words[first:end])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds the sentences of few texts at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _emit_runs(sentences_: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ends, h, c, at = [], [], [], []
            for text in batch.column("text").to_pylist():
                sizes, counts, told = [], [], bytearray()
                # A run is told by the digests of its sentences, so each sentence is hashed once.
                for part, n, words in _units(text):
                    sizes.append(len(part))
                    counts.append(n)
                    told += xxhash.xxh3_128_digest(" ".join(words)) if words else _WORDLESS
                digests = bytes(told)
                found = [(a, e) for a, e in _run_bounds(counts, sentences_, least_words) if digests[16 * a : 16 * a + 16] != _WORDLESS]
                marks = np.frombuffer(b"".join([xxhash.xxh3_128_digest(digests[16 * a : 16 * e]) for a, e in found]), "<u8").reshape(-1, 2)
                ends.append(np.cumsum(sizes, dtype=np.int32))
                h.append(marks[:, 0].view(np.int64))
                c.append(marks[:, 1].astype(np.uint32).view(np.int32))
                at.append(np.array([a << 32 | e for a, e in found], np.int64))
            columns = [pa.array(ends, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "id", "row")), *columns], names=["doc_id", "id", "row", "ends", "h", "c", "at"])

    return run


def _drop_covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        carried = [c for c in batch.schema.names if c not in ("doc_id", "text", "n_sentences", "ends", "runs")]
        kept, gone, spans = [], [], []
        for text, ends, found in zip(*(batch.column(c).to_pylist() for c in ("text", "ends", "runs")), strict=True):
            parts, at, last, removed, count = [], 0, -1, 0, 0
            for first, end in sorted((x >> 32, x & 0xFFFFFFFF) for x in found or ()):
                if first > last:
                    begin = ends[first - 1] if first else 0
                    parts.append(text[at:begin])
                    count, last, at = count + 1, first, begin
                if end > last:
                    removed, last, at = removed + end - last, end, ends[end - 1]
            kept.append("".join([*parts, text[at:]]) if found else text)
            gone.append(removed)
            spans.append(count)
        columns = [batch.column("doc_id"), pa.array(kept, pa.string()), batch.column("n_sentences"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())]
        columns += [batch.column(c) for c in carried]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_sentences", "n_removed", "n_spans", *carried])


def remove_repeated(docs: DataFrame, sentences_: int = SENTENCES, least_words: int = LEAST_WORDS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text (kept), n_sentences, n_removed, n_spans: texts without repeated passages.

    Runs of consecutive sentences (from each sentence on and up to each sentence, the shortest of at
    least three sentences and 25 words) are hashed over the whole table. The first place of a run, by
    doc_id and place in the text, stays; sentences that any other place covers are removed.
    Rows that repeat doc_id and text are documents of their own: one of them counts as the first.
    Null doc_ids come first. Null texts stay null; texts shorter than a run are left alone; a text may
    become empty. An empty table gives none. Columns named in carry (not doc_id or text) are passed on,
    others ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"_carry_{c}") for c in carry or ()))
    # Rows are told apart by doc_id where that is enough, else by the text too, else by a number.
    none = F.lit(0).cast("long")
    known = rows.withColumn("id", F.xxhash64("doc_id", "text"))
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        known = rows.withColumn("id", none).withColumn("row", none)
    elif known.filter("text is not null").groupBy("doc_id", "id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        known = known.withColumn("row", none)
    else:
        known = stage(known.withColumn("row", F.monotonically_increasing_id()), "span-rows")
    cut = known.select("doc_id", "id", "row", "text").filter("text is not null").mapInArrow(_emit_runs(sentences_, least_words), CUT)
    cut = stage(cut, "span-sentences")
    one = F.col("x")
    found = cut.select("doc_id", "id", "row", F.explode(F.arrays_zip("h", "c", "at")).alias("x")).select(
        "doc_id", "id", "row", one["h"].alias("h"), one["c"].alias("c"), one["at"].alias("at")
    )
    place = F.struct("doc_id", "id", "row", "at")
    # Staged, so that the join reads plain shuffles and a hot run can be split.
    first = stage(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("h", "c", "first"), "span-first")
    later = found.join(first, ["h", "c"]).filter(place != F.col("first"))
    covered = later.groupBy("doc_id", "id", "row").agg(F.collect_set("at").alias("runs"))
    same = lambda n: F.col(f"a{n}.doc_id").eqNullSafe(F.col(f"b{n}.doc_id")) & (F.col(f"a{n}.id") == F.col(f"b{n}.id")) & (F.col(f"a{n}.row") == F.col(f"b{n}.row"))
    told = cut.alias("a1").join(covered.alias("b1"), same(1), "left").select(
        "a1.doc_id", "a1.id", "a1.row", F.size("ends").cast("long").alias("n_sentences"), F.when(F.col("runs").isNotNull(), F.col("ends")).alias("ends"), "runs"
    )
    kept = known.alias("a2").join(told.alias("b2"), same(2), "left").select(
        "a2.doc_id", "text", F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"), "ends", "runs", *(f"_carry_{c}" for c in carry or ())
    )
    kinds = "".join(f", _carry_{c} {docs.schema[c].dataType.simpleString()}" for c in carry or ())
    kept = kept.mapInArrow(_drop_covered, "doc_id long, text string, n_sentences long, n_removed long, n_spans long" + kinds)
    return kept.withColumnsRenamed({f"_carry_{c}": c for c in carry or ()})
