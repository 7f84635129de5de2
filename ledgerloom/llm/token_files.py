"""Token ids as Parquet list columns, made for reading few documents, few tokens or only metadata.

Documents are dealt by ranges of their id, so the files follow each other in id order and so do the
rows in a file. Ids are dictionary-coded (or delta-coded), the numbers that describe documents are
delta-coded, row groups and pages have set sizes, and page indexes tell a reader which pages hold
the documents or token positions it wants.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import byte_letters
from ledgerloom.llm.common import shared_folder

#: Stands after each document.
END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1_000
#: Different pieces of text whose ids a task keeps, and bytes of text that are encoded together.
KEPT_PIECES = 400_000
GROUP_BYTES = 4_000_000
#: part: number of the file; start, stop: tokens of the file before and up to the end of the document.
TOKENS = "doc_id long, part int, start long, stop long, ids array<int>"

#: Sentence signs at the end of a piece become a piece of their own; letters and signs never share a token.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įıĴ-ńŊ-ž"
_LAST_SIGNS = rf"([0-9{_LETTERS}])([.,;:!?]+)([ \t\n\x0b\x0c\r]|$)"
#: Pieces that normalise to their lower case and are one word each.
_WORD = re.compile(f"[{_LETTERS}]+")


class Pieces:
    """Encodes texts by their different pieces between blanks, each of which the tokenizer sees once.

    Blanks always part tokens in these vocabularies, so a text's ids are those of its pieces in a row.
    """

    def __init__(self, spec_text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spelling = str.maketrans({chr(b): letter for b, letter in byte_letters().items()})
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.met = np.zeros(1 << 12, bool)
        self.used = 0

    def _thin(self) -> None:
        """Forget the pieces that were met in one group of texts only, or all where that leaves too many."""
        again = np.flatnonzero(self.met[: len(self.number)])
        if len(again) > KEPT_PIECES // 2:
            return self._forget()
        words = [*self.number]
        begin, sizes = self.starts[again], self.starts[again + 1] - self.starts[again]
        ends = np.cumsum(sizes)
        self.used = int(sizes.sum())
        self.ids[: self.used] = self.ids[np.arange(self.used) + np.repeat(begin - ends + sizes, sizes)]
        self.starts[1 : len(again) + 1] = ends
        self.met[:] = False
        self.number = {words[i]: n for n, i in enumerate(again.tolist())}

    def _learn(self, pieces: list[str]) -> None:
        # Plain words go to the library's model at once, all else through its whole chain.
        tokenize, spelling, plain, sizes, found = self.tokenizer.model.tokenize, self.spelling, [], [], []
        others = []
        for piece in pieces:
            if _WORD.fullmatch(piece):
                low = piece.lower()
                ids = [t.id for t in tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(spelling))]
                plain.append(piece)
                sizes.append(len(ids))
                found += ids
            else:
                others.append(piece)
        for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False):
            ids = e.ids
            sizes.append(len(ids))
            found += ids
        pieces = plain + others
        ends = self.used + np.cumsum(np.array(sizes, np.int64))
        known = len(self.number)
        if known + len(pieces) + 1 > len(self.starts):
            more = max(len(self.starts), len(pieces) + 1)
            self.starts, self.met = np.concatenate((self.starts, np.zeros(more, np.int64))), np.concatenate((self.met, np.zeros(more, bool)))
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(found)), np.int32)))
        self.starts[known + 1 : known + 1 + len(pieces)] = ends
        self.ids[self.used : ends[-1]] = np.array(found, np.int32)
        self.used = int(ends[-1])
        self.number.update(zip(pieces, range(known, known + len(pieces)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's start in it."""
        parted = pc.replace_substring_regex(texts.fill_null(""), _LAST_SIGNS, r"\1 \2\3")
        parts = pc.ascii_split_whitespace(parted)
        coded = parts.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.number) > KEPT_PIECES:
            self._thin()
        known = len(self.number)
        missing = [w for w in pieces if w not in self.number]
        if missing:
            self._learn(missing)
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        self.met[numbers[numbers < known]] = True
        numbers = numbers[np.asarray(coded.indices)]
        begin = self.starts[numbers]
        ends = np.cumsum(self.starts[numbers + 1] - begin)
        sizes = np.diff(ends, prepend=0)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)]
        offsets = np.asarray(parts.offsets).astype(np.int64)
        return ids, np.concatenate(([0], ends))[offsets - offsets[0]]


@lru_cache(maxsize=1)
def _pieces(spec_text: str) -> Pieces:
    return Pieces(spec_text)


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of up to GROUP_BYTES, or one row."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > GROUP_BYTES:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _emit_tokens(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, at = _pieces(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for first, end in _groups(np.asarray(pc.binary_length(texts.fill_null(""))).astype(np.int64)):
                ids, bounds = pieces.encode(texts.slice(first, end - first))
                closed = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                columns = [
                    batch.column("doc_id").slice(first, end - first),
                    pa.array(np.full(end - first, part, np.int32)),
                    pa.array(at + bounds[:-1]),
                    pa.array(at + bounds[1:]),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(closed)),
                ]
                at += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start", "stop", "ids"])

    return run


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    path: str,
    end_id: int = END_ID,
    ids_encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write the ids of every whole text, each followed by end_id, to path/tokens, and path/files.

    Rows stand in ascending order of doc_id (null first; rows of one doc_id by a hash of the text),
    across files by `part` and within each. ids_encoding: "dictionary" or "delta". path/files has
    part, documents, tokens and start (tokens of all files before). Null texts count as empty: end_id
    alone. Repeated rows stay. Other columns are ignored. An empty table gives files without rows.
    """
    if ids_encoding not in ("dictionary", "delta"):
        raise ValueError("ids_encoding is dictionary or delta")
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        # One file of fixed size, so every task may hold it.
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The last column spreads repeated rows over tasks too.
    order = ["doc_id", "_text", "_row"]
    dealt = rows.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#part": "true",
        "parquet.enable.dictionary#ids.list.element": str(ids_encoding == "dictionary").lower(),
    }
    tokens = dealt.select("doc_id", "text").mapInArrow(_emit_tokens(spec, end_id), TOKENS)
    tokens.write.options(**options).parquet(f"{path}/tokens")
    files = spark.read.schema(TOKENS).parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("documents"), F.max("stop").alias("tokens"))
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/files")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, documents long, tokens long, start long").parquet(f"{path}/files")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: start counts the tokens of all documents before.

    Columns that are not used are not read, and conditions on doc_id skip files, row groups and pages.
    """
    base = _files(spark, path).select("part", F.col("start").alias("_base"))
    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens").join(base, "part")
    return rows.select("doc_id", (F.col("_base") + F.col("start")).alias("start"), (F.col("stop") - F.col("start")).alias("n_tokens"), "ids")


def read_window(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """doc_id, start, n_tokens, ids of the tokens first..end-1 of the whole corpus.

    start is the place of the first of these ids. Only pages with such tokens are read.
    """
    held = _files(spark, path).filter((F.col("start") < end) & (F.col("start") + F.col("tokens") > first))
    # At most two rows: the files at the ends of the window.
    ends = held.agg(F.min(F.struct("part", "start")).alias("a"), F.max(F.struct("part", "start")).alias("b")).first()
    if ends.a is None or first >= end:
        return read_tokens(spark, path).filter("false")
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens").filter(F.col("part").between(ends.a.part, ends.b.part))
    tokens = tokens.filter((F.col("part") > ends.a.part) | (F.col("stop") > first - ends.a.start))
    tokens = tokens.filter((F.col("part") < ends.b.part) | (F.col("start") < end - ends.b.start))
    placed = tokens.join(_files(spark, path).select("part", F.col("start").alias("_base")), "part")
    lo = F.greatest(F.col("_base") + F.col("start"), F.lit(first))
    n = F.least(F.col("_base") + F.col("stop"), F.lit(end)) - lo
    cut = F.slice("ids", (lo - F.col("_base") - F.col("start") + 1).cast("int"), n.cast("int"))
    return placed.select("doc_id", lo.alias("start"), n.alias("n_tokens"), cut.alias("ids"))


def _emit_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = memoryview(np.ascontiguousarray(np.asarray(ids.values).astype("<u4")).view(np.uint8))
        bounds = np.asarray(ids.offsets).astype(np.int64) * 4
        crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def written_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from files written to the shared folder.

    Cases as in write_tokens; the folder belongs to the application, as in common.stage.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, vocabulary, path)
    return read_tokens(spark, path).mapInArrow(_emit_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
