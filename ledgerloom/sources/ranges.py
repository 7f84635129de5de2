"""Large statement files, split over tasks by byte range.

Spark's text reader cuts files into blocks at line ends. Whether a block starts inside a quoted cell
depends on all blocks before it, so every block is first summed up: quotes and lines, the lines'
delimiter counts, and the function from the state at its start to the state at its end. A running
composition of these functions over the blocks of a file, one small row each, gives every block its
true start; then all blocks are cut into records at once. Results are those of `files.profile_files`
without a limit on the size, apart from the content hash, which has to be put together from blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.functions.text import normalize_column_name, strip
from ledgerloom.operators.skew import is_small
from ledgerloom.sources import files
from ledgerloom.sources.files import DELIMITERS, HEADER_FIRST_RECORDS, UNDEFINED_1252

BLOCK = "uri string, block bigint"
_QUOTE = b'"'
# A quoted run, anywhere in a line, that closes; and the end of one that was open before.
_CLOSED = re.compile(rb'"[^"]*+(?:""[^"]*+)*+"')
_CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
# Lines of blocks go to the broadcast table of block starts up to so many blocks.
BROADCAST_BLOCKS_MAX = 200_000


def _cell_patterns(delimiter: bytes) -> tuple[re.Pattern, re.Pattern]:
    """(whole line of complete cells, rest of such a line after a closing quote)."""
    d = re.escape(delimiter)
    cell = rb'(?:"[^"]*+(?:""[^"]*+)*+"[^' + d + rb"]*+|(?!\")[^" + d + rb"]*+)"
    more = rb"(?:" + d + cell + rb")*+"
    return re.compile(cell + more, re.S), re.compile(rb"[^" + d + rb"]*+" + more, re.S)


_PATTERNS = {d: _cell_patterns(d.encode()) for d in DELIMITERS}


def _next_state(line: bytes, inside: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open at the end of a line, by whether one is at its start."""
    whole, rest = _PATTERNS[delimiter]
    if not inside:
        return whole.fullmatch(line) is None
    closed = _CLOSING.match(line)
    return closed is None or rest.fullmatch(line, closed.end()) is None


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """uri, block, size of the file and value (bytes up to the next line feed), in order within a block."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[cC][sS][vV],[tT][xX][tT]}")
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def _physical(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines as universal newlines part them, and the number of lines of each value."""
    has_cr = np.array(pc.match_substring(values, b"\r"))
    ends_cr = np.array(pc.ends_with(values, b"\r"))
    counts = np.ones(len(values), np.int64)
    if not has_cr.any():
        return values, counts
    lines: list[bytes] = []
    for i, value in enumerate(values.to_pylist()):
        parts = (value[:-1] if ends_cr[i] else value).split(b"\r") if has_cr[i] else [value]
        counts[i] = len(parts)
        lines += parts
    return pa.array(lines, pa.binary()), counts


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, pa.Array]]:
    """(uri, block), the first row's other columns, values: consecutive rows of one block."""
    for batch in batches:
        uris, blocks = batch.column("uri"), np.asarray(batch.column("block"))
        codes = np.asarray(uris.dictionary_encode().indices)
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        bounds = [0, *edges.tolist(), batch.num_rows]
        for first, end in zip(bounds[:-1], bounds[1:], strict=True):
            if first < end:
                others = {c: batch.column(c)[first].as_py() for c in batch.schema.names if c not in ("uri", "block", "value")}
                yield (uris[first].as_py(), int(blocks[first])), others, batch.column("value").slice(first, end - first)


def _measured(lines: DataFrame) -> DataFrame:
    """Per block: lines, quotes, and what tells the encoding. Summed before any shuffle."""
    value = F.col("value")
    raw = value.cast("binary")
    size = F.octet_length("value")
    without = lambda mark: F.octet_length(F.replace(value, F.lit(mark), F.lit("")))
    # A carriage return before the line feed belongs to it; others end lines of their own.
    returns = size - without("\r") - F.when(value.endswith("\r"), 1).otherwise(0)
    as_latin = F.decode(raw, "ISO-8859-1")
    return lines.groupBy("uri", "block").agg(
        F.sum(returns + 1).alias("lines"),
        F.sum(size - without('"')).alias("quotes"),
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_or(as_latin.contains("\x00")).alias("nul"),
        F.bool_or(as_latin.rlike(f"[{UNDEFINED_1252}]")).alias("undefined"),
    )


def _starts(measured: DataFrame) -> DataFrame:
    """Per block: line0, whether quotes are open before it, and the file's encoding and parity. Windows over blocks."""
    whole = Window.partitionBy("uri")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    encoding = F.when(F.bool_and("utf8").over(whole), F.when(~F.bool_or("nul").over(whole), F.lit("utf-8-sig"))).when(
        ~F.bool_or("nul").over(whole) & ~F.bool_or("undefined").over(whole), F.lit("cp1252")
    )
    return measured.select(
        "uri",
        "block",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("line0"),
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("quotes").over(whole) % 2 == 1).alias("unclosed"),
        encoding.alias("encoding"),
    )


def _joined(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines with their block's start, each block still in order and in one task."""
    rows = lines.select("uri", "block", "value")
    if is_small(starts, BROADCAST_BLOCKS_MAX):
        return rows.join(F.broadcast(starts), ["uri", "block"])
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).join(starts, ["uri", "block"])
    return rows.repartition("uri", "block").sortWithinPartitions("uri", "block", "_at").drop("_at")


def _last_openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the last line in which a quoted run opens, -1 for none, of files whose quotes don't close."""
    found: dict[tuple, int] = {}
    state: dict[tuple, tuple[int, bool]] = {}
    for key, start, values in _by_block(batches):
        number, inside = state.get(key, (start["line0"], start["inside"]))
        lines, _ = _physical(values.cast(pa.binary()))
        quoted = np.flatnonzero(np.array(pc.match_substring(lines, _QUOTE)))
        for i in quoted.tolist():
            line = lines[i].as_py()
            if inside:
                closed = _CLOSING.match(line)
                if closed is None:
                    continue
                line = line[closed.end() :]
            inside = _QUOTE in _CLOSED.sub(b"", line)
            if inside:
                found[key] = number + i
        state[key] = number + len(lines), inside
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(found.values(), pa.int64())], names=["uri", "block", "opened"]
    )


EVIDENCE = f"{BLOCK}, kind string, delimiter int, n bigint, lines bigint, counts array<bigint>, ends array<struct<clear:boolean,records:bigint,quoted:boolean,records_quoted:bigint>>, mark0 decimal(38,0), mark1 decimal(38,0)"


class _Block:
    """What one block tells about delimiters, record states and content."""

    def __init__(self, start: dict):
        self.number, self.inside, self.opened = start["line0"], start["inside"], start["opened"]
        self.whole: Counter = Counter()
        #: Counts of the logical line at hand; the first one may have begun in an earlier block.
        self.now = np.zeros(len(DELIMITERS), np.int64)
        self.head: np.ndarray | None = None
        self.is_head = self.inside and not self._open_end(self.number)
        #: Per delimiter: state and records so far, from a clear and from a quoted start.
        self.states = [[False, 0, True, 0] for _ in DELIMITERS]
        self.marks = [0, 0]

    def _open_end(self, number: int) -> bool:
        """Whether the line lies after a run that never closes: all of it counts."""
        return self.opened is not None and number > self.opened

    def _end_line(self) -> None:
        if self.is_head:
            self.head, self.is_head = self.now, False
        else:
            for i, n in enumerate(self.now.tolist()):
                if n:
                    self.whole[i, n] += 1
        self.now = np.zeros(len(DELIMITERS), np.int64)

    def _plain(self, counts: np.ndarray, first: int, end: int) -> None:
        """Lines first..end-1 without quotes."""
        if first == end:
            return
        for state in self.states:
            state[1] += 0 if state[0] else end - first
            state[3] += 0 if state[2] else end - first
        if self.inside and not self._open_end(self.number + first):
            return
        for i in range(len(DELIMITERS)):
            for n, lines in zip(*np.unique(counts[i, first:end], return_counts=True), strict=True):
                if n:
                    self.whole[i, int(n)] += int(lines)

    def _quoted(self, line: bytes, number: int) -> None:
        for state, delimiter in zip(self.states, DELIMITERS, strict=True):
            for at in (0, 2):
                state[at + 1] += not state[at]
                state[at] = _next_state(line, state[at], delimiter)
        if self._open_end(number):
            self.inside = False
        text = line
        if self.inside:
            closed = _CLOSING.match(text)
            if closed is None:
                return
            text, self.inside = text[closed.end() :], False
        text = _CLOSED.sub(b"", text)
        opening = text.find(_QUOTE)
        if opening >= 0 and self.opened != number and not self._open_end(number):
            text, self.inside = text[:opening], True
        self.now += [text.count(d.encode()) for d in DELIMITERS]
        if not self.inside:
            self._end_line()

    def add(self, values: pa.Array) -> None:
        lines, _ = _physical(values)
        quoted = np.flatnonzero(np.array(pc.match_substring(lines, _QUOTE)))
        counts = np.stack([np.array(pc.count_substring(lines, d.encode())) for d in DELIMITERS])
        at = 0
        for i in quoted.tolist():
            self._plain(counts, at, i)
            self._quoted(lines[i].as_py(), self.number + i)
            at = i + 1
        self._plain(counts, at, len(lines))
        for i, line in enumerate(lines.to_pylist()):
            for k in (0, 1):
                self.marks[k] += xxhash.xxh3_64_intdigest(line, (self.number + i) * 2 + k)
        self.number += len(lines)

    def rows(self, key: tuple) -> Iterator[tuple]:
        for (i, n), lines in self.whole.items():
            yield (*key, "whole", i, n, lines, None, None, None, None)
        open_tail = self.inside and not self._open_end(self.number)
        if self.is_head:
            yield (*key, "head", None, None, None, self.now.tolist(), None, None, None)
        elif self.head is not None:
            yield (*key, "head", None, None, None, self.head.tolist(), None, None, None)
        if open_tail and not self.is_head:
            yield (*key, "tail", None, None, None, self.now.tolist(), None, None, None)
        ends = [dict(zip(("clear", "records", "quoted", "records_quoted"), s, strict=True)) for s in self.states]
        yield (*key, "block", None, None, None, None, ends, *self.marks)


def _emit_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from decimal import Decimal

    blocks: dict[tuple, _Block] = {}
    for key, start, values in _by_block(batches):
        if key not in blocks:
            blocks[key] = _Block(start)
        blocks[key].add(values.cast(pa.binary()))
    rows = [[*r[:-2], *(None if m is None else Decimal(m) for m in r[-2:])] for key, block in blocks.items() for r in block.rows(key)]
    ends = pa.list_(pa.struct([("clear", pa.bool_()), ("records", pa.int64()), ("quoted", pa.bool_()), ("records_quoted", pa.int64())]))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), ends, pa.decimal128(38), pa.decimal128(38)]
    names = ["uri", "block", "kind", "delimiter", "n", "lines", "counts", "ends", "mark0", "mark1"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _delimiters(evidence: DataFrame) -> DataFrame:
    """uri, delimiter: as `files.detect_delimiter` judges the whole file."""
    pieces = evidence.where("kind in ('head', 'tail')")
    # A tail begins a logical line that the heads of later blocks continue.
    order = Window.partitionBy("uri").orderBy("block", F.col("kind") == "tail")
    line = F.sum((F.col("kind") == "tail").cast("int")).over(order)
    parts = pieces.select("uri", line.alias("line"), *[F.col("counts")[i].alias(f"c{i}") for i in range(len(DELIMITERS))])
    sums = parts.groupBy("uri", "line").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(DELIMITERS))])
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("delimiter"), F.col(f"c{i}").alias("n")) for i in range(len(DELIMITERS))])).alias("x")
    split = sums.select("uri", one).select("uri", "x.delimiter", "x.n", F.lit(1).cast("bigint").alias("lines")).where("n > 0")
    counted = evidence.where("kind = 'whole'").select("uri", "delimiter", "n", "lines").unionByName(split)
    agreeing = counted.groupBy("uri", "delimiter", "n").agg(F.sum("lines").alias("lines"))
    each = agreeing.groupBy("uri", "delimiter").agg(F.max("lines").alias("lines"), F.sum(F.col("n") * F.col("lines")).alias("total"))
    best = F.max(F.struct("lines", "total", (-F.col("delimiter")).alias("order"), "delimiter")).alias("best")
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    return each.groupBy("uri").agg(best).select("uri", F.get(names, F.col("best.delimiter")).alias("delimiter"))


def _block_states(evidence: DataFrame, delimiters: DataFrame) -> DataFrame:
    """uri, block, delimiter, quoted (state at its start), record0 (records begun before): blocks composed in order."""
    ends = evidence.where("kind = 'block'").select("uri", "block", "ends").join(delimiters, "uri")
    place = F.array_position(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("delimiter")).cast("int")
    blocks = ends.select("uri", "delimiter", F.struct("block", F.get("ends", place - 1).alias("e")).alias("b"))
    # Blocks of one file: as many as Spark cuts it into, a small struct each.
    ordered = blocks.groupBy("uri", "delimiter").agg(F.array_sort(F.collect_list("b")).alias("b"))
    kind = "array<struct<block:bigint,quoted:boolean,record0:bigint>>"
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("bigint").alias("record0"), F.array().cast(kind).alias("out"))

    def step(state: Column, b: Column) -> Column:
        at = F.struct(b["block"].alias("block"), state["quoted"].alias("quoted"), state["record0"].alias("record0"))
        return F.struct(
            F.when(state["quoted"], b["e"]["quoted"]).otherwise(b["e"]["clear"]).alias("quoted"),
            (state["record0"] + F.when(state["quoted"], b["e"]["records_quoted"]).otherwise(b["e"]["records"])).alias("record0"),
            F.array_append(state["out"], at).alias("out"),
        )

    found = ordered.select("uri", "delimiter", F.explode(F.aggregate("b", start, step, lambda s: s["out"])).alias("x"))
    return found.select("uri", "x.block", "delimiter", "x.quoted", "x.record0")


RECORD = "uri string, record bigint, block bigint, piece boolean, row_number bigint, raw string"


def _emit_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict[tuple, dict] = {}

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        names = ["uri", "record", "block", "piece", "row_number", "raw"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def close(key: tuple, s: dict, rows: list[tuple], last: bool = False) -> None:
        """The record at hand is complete, or the block ends within it."""
        if s["lines"]:
            piece = s["continued"] or last
            rows.append((key[0], s["record"], key[1], piece, s["number"], "\n".join(s["lines"])))
        s["lines"], s["continued"] = [], False

    for key, start, values in _by_block(batches):
        s = state.get(key)
        if s is None:
            s = state[key] = {"quoted": start["quoted"], "record": start["record0"] - 1, "number": start["line0"], "lines": [], "continued": start["quoted"]}
        encoding, delimiter = "utf-8" if start["encoding"] == "utf-8-sig" else "cp1252", start["delimiter"]
        lines, _ = _physical(values.cast(pa.binary()))
        quoted = np.array(pc.match_substring(lines, _QUOTE))
        rows: list[tuple] = []
        for line, has_quote in zip(lines.to_pylist(), quoted.tolist(), strict=True):
            if not s["quoted"]:
                s["record"] += 1
            s["number"] += 1
            text = line.decode(encoding)
            if s["number"] == 1 and encoding == "utf-8":
                text = text.removeprefix("﻿")
                line = text.encode()
            s["lines"].append(text)
            if has_quote:
                s["quoted"] = _next_state(line, s["quoted"], delimiter)
            if not s["quoted"]:
                close(key, s, rows)
        if rows:
            yield told(rows)
    rows = []
    for key, s in state.items():
        close(key, s, rows, last=True)
    if rows:
        yield told(rows)


def _records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """uri, record, row_number, raw: pieces of records that lie in several blocks put together."""
    emitted = _joined(lines, starts).mapInArrow(_emit_records, RECORD)
    whole = emitted.where("not piece").select("uri", "record", "row_number", "raw")
    parts = emitted.where("piece").groupBy("uri", "record").agg(
        F.max("row_number").alias("row_number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "raw"))), lambda p: p["raw"]), "\n").alias("raw")
    )
    return whole.unionByName(parts)


def _headers(records: DataFrame) -> DataFrame:
    """uri, header_at: found among the first records, else among the others."""
    names = F.transform(F.filter("cells", lambda c: strip(c) != ""), normalize_column_name)
    known = records.select("uri", "record", "cells", files.header_score(F.array_distinct(names)).alias("score"), (F.size(names) >= 2).alias("wide"))

    def found(some: DataFrame) -> DataFrame:
        best = F.max(F.struct("score", (-F.col("record")).alias("at"))).alias("best")
        each = some.groupBy("uri").agg(best, F.min(F.when(F.col("wide"), F.col("record"))).alias("first_wide"))
        at = F.coalesce(F.when(F.col("best.score") > 0, -F.col("best.at")), F.col("first_wide"))
        return each.select("uri", at.alias("header_at")).where("header_at is not null")

    early = found(known.where(F.col("record") < HEADER_FIRST_RECORDS))
    later = known.where(F.col("record") >= HEADER_FIRST_RECORDS).join(early, "uri", "left_anti")
    return early.unionByName(found(later))


def profile_ranges(spark: SparkSession, path: str | list[str], listing: DataFrame, stage) -> tuple[DataFrame, DataFrame]:
    """(profiles, records) of the files of ``listing`` (path, modificationTime, length, uri) below ``path``.

    profiles: as `files.profile_files`, without records. records: path, row_number, cells of the
    data rows. ``stage(frame, name)`` stores a frame and reads it back. A quoted cell that never
    closes runs to the end of the file, in one row. source_file_hash stands for the numbered lines of
    the file; it does not depend on the blocks.
    """
    wanted = listing.select("uri")
    lines = read_lines(spark, path)
    lines = lines.join(F.broadcast(wanted) if is_small(wanted) else wanted, "uri", "left_semi")
    starts = stage(_starts(_measured(lines)), "range-starts")
    open_files = starts.where("unclosed and encoding is not null")
    opened = None
    if not open_files.isEmpty():
        opened = _joined(lines, open_files).mapInArrow(_last_openings, f"{BLOCK}, opened bigint").groupBy("uri").agg(F.max("opened").alias("opened"))
        opened = stage(opened, "range-openings")
    begun = starts.withColumn("opened", F.lit(None).cast("bigint")) if opened is None else starts.join(opened, "uri", "left")
    evidence = stage(_joined(lines, begun).mapInArrow(_emit_evidence, EVIDENCE), "range-evidence")
    delimiters = stage(_delimiters(evidence), "range-delimiters")
    readable = starts.where("encoding is not null").select("uri", "block", "line0", "encoding")
    known = stage(_block_states(evidence, delimiters).join(readable, ["uri", "block"]), "range-blocks")
    cut = _records(lines, known).join(F.broadcast(delimiters) if is_small(delimiters) else delimiters, "uri")
    records = stage(cut.select("uri", "record", "row_number", files.split_cells(F.col("raw"), F.col("delimiter")).alias("cells")), "range-records")
    headers = stage(_headers(records), "range-headers")
    at_header = records.join(F.broadcast(headers) if is_small(headers) else headers, "uri")
    named = at_header.where("record = header_at").select("uri", "header_at", F.transform("cells", normalize_column_name).alias("columns"))
    named = stage(named, "range-columns")
    data = records.join(F.broadcast(named) if is_small(named) else named, "uri").where(F.col("record") > F.col("header_at")).where(~files.is_blank_record(F.col("cells")))
    counts = data.groupBy("uri").agg(F.count("*").alias("rows"), F.count_if(F.size("cells") != F.size("columns")).alias("irregular"))
    whole = evidence.where("kind = 'block'").groupBy("uri").agg(F.sum("mark0").alias("mark0"), F.sum("mark1").alias("mark1"))
    encodings = starts.groupBy("uri").agg(F.first("encoding").alias("encoding"))
    content = F.sha2(F.concat_ws(":", F.lit("lines"), "length", "mark0", "mark1"), 256)
    profiles = listing.join(encodings, "uri").join(whole, "uri").join(delimiters, "uri", "left").join(named, "uri", "left").join(counts, "uri", "left")
    has_header = F.col("header_at").isNotNull()
    profiles = profiles.withColumn("delimiter", F.when(F.col("encoding").isNotNull(), F.col("delimiter"))).select(
        "path",
        "modificationTime",
        "length",
        keys.name_uuid(content).alias("file_id"),
        content.alias("source_file_hash"),
        "encoding",
        "delimiter",
        (F.col("header_at") + 1).cast("int").alias("header_row_number"),
        "columns",
        F.when(has_header, F.coalesce("rows", F.lit(0))).cast("bigint").alias("row_count"),
        F.when(has_header, F.coalesce("irregular", F.lit(0))).cast("bigint").alias("irregular_row_count"),
        files.signature(F.col("columns"), F.col("delimiter")).alias("signature"),
        files.profile_issue(F.col("header_at")).alias("issue_code"),
    )
    paths = listing.select("uri", "path")
    rows = data.join(F.broadcast(paths) if is_small(paths) else paths, "uri").select("path", F.col("row_number").cast("int").alias("row_number"), "cells")
    return profiles, rows
