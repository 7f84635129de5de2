"""Statement files: scan, decode, split into records, and profile.

Everything about a file of ordinary size is computed inside its own row, so profiling
needs no shuffle and never moves file bytes between tasks. Files over SPLIT_BYTES are
cut into byte ranges by :mod:`ledgerloom.sources.ranges`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.functions.text import let, normalize_column_name, strip

# Larger files are read by ranges. Their content hash is another one, so a changed limit makes
# earlier imports of the files between the two limits unknown.
SPLIT_BYTES = 32 << 20
# Records looked at first for a header; the others only if none of these qualifies.
HEADER_FIRST_RECORDS = 30
DELIMITERS = [",", ";", "\t", "|"]

# Column names that mark a header row.
HEADER_WORDS = [
    "data",
    "date",
    "data movimento",
    "data transacao",
    "hora",
    "time",
    "tipo",
    "historico",
    "descricao",
    "detalhes",
    "origem destino",
    "valor",
    "montante",
    "amount",
    "credito",
    "debito",
    "saldo",
    "balance",
    "docto",
    "documento",
    "forma de pagamento",
    "natureza",
]

# Bytes 0x80-0x9F as Latin-1 characters, and what Windows-1252 means by them.
_C1 = "".join(chr(code) for code in range(0x80, 0xA0))
UNDEFINED_1252 = "\x81\x8d\x8f\x90\x9d"
_C1_DEFINED = "".join(char for char in _C1 if char not in UNDEFINED_1252)
_CP1252 = _C1_DEFINED.encode("latin-1").decode("cp1252")

# A quoted run opens only at the start of a cell; possessive, so long cells do
# not recurse. DLM is replaced by the file's delimiter.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
# An opening quote that never closes runs to the end.
_OPENED = '"[^"]*+(?:""[^"]*+)*+(?:"|\\z)'
_RECORD = rf"\n((?:{_OPENED}[^DLM\n]*+|[^DLM\n]*+)(?:DLM(?:{_OPENED}[^DLM\n]*+|[^DLM\n]*+))*+)"
_CELL = rf"(?s)DLM({_OPENED}[^DLM]*+|[^DLM]*+)"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes only; no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "modificationTime", "length", F.col("_metadata.file_path").alias("uri"))
    )


def escaped_path(path: str) -> str:
    """A path as a pattern that only matches itself."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_files(spark: SparkSession, path: str | list[str], max_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Content of acceptable files of at most ``max_bytes``. Suffix and size are applied before any read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{[cC][sS][vV],[tT][xX][tT]}")
        .load(path)
        .where(F.col("length") <= max_bytes)
        .select("path", "modificationTime", "length", "content")
    )


def suffix_is_supported(path: Column) -> Column:
    return F.lower(path).rlike(r"[^/]\.(csv|txt)$")


def refused_files(
    listing: DataFrame, requested: DataFrame | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Files that are not opened: wrong suffix, over a limit if there is one, or (if asked for) absent."""
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    code = F.when(~suffix_is_supported(F.col("path")), F.lit("unsupported_file_type")).when(
        too_large, F.lit("file_too_large")
    )
    refused = listing.select("path", "length", code.alias("issue_code")).where("issue_code is not null")
    if requested is None:
        return refused
    absent = requested.join(listing, "path", "left_anti").select(
        "path",
        F.lit(None).cast("bigint").alias("length"),
        F.when(suffix_is_supported(F.col("path")), F.lit("unreadable_file"))
        .otherwise(F.lit("unsupported_file_type"))
        .alias("issue_code"),
    )
    return refused.unionByName(absent)


def decode_files(files: DataFrame) -> DataFrame:
    """Adds source_file_hash, file_id, encoding and text (newlines as ``\\n``)."""
    as_utf8 = F.col("content").cast("string")
    as_latin = F.decode(F.col("content"), "ISO-8859-1")
    out = files.withColumn("source_file_hash", F.sha2("content", 256)).withColumn(
        "encoding",
        F.when(F.is_valid_utf8(as_utf8), F.when(~as_utf8.contains("\x00"), F.lit("utf-8-sig"))).when(
            ~as_latin.rlike(f"[\x00{UNDEFINED_1252}]"), F.lit("cp1252")
        ),
    )
    text = F.when(F.col("encoding") == "utf-8-sig", F.regexp_replace(as_utf8, "^\ufeff", "")).when(
        F.col("encoding") == "cp1252", F.translate(as_latin, _C1_DEFINED, _CP1252)
    )
    return out.withColumn("file_id", keys.name_uuid(F.col("source_file_hash"))).withColumn(
        "text", F.regexp_replace(text, "\r\n?", "\n")
    )


def detect_delimiter(text: Column) -> Column:
    """The delimiter whose per-line count is the most consistent, null if none occurs.

    Quoted runs do not count. Ties go to the more frequent delimiter, then to the
    order comma, semicolon, tab, pipe.
    """
    sample = F.regexp_replace(text, _QUOTED, "")

    def score(lines: Column, order: int, delimiter: str) -> Column:
        def with_counts(counts: Column) -> Column:
            # Longest run of equal counts once they are sorted.
            start = F.struct(F.lit(0).alias("value"), F.lit(0).alias("run"), F.lit(0).alias("best"))

            def step(state: Column, n: Column) -> Column:
                run = F.when(n == state["value"], state["run"] + 1).otherwise(F.lit(1))
                return F.struct(n.alias("value"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

            seen = F.sort_array(F.filter(counts, lambda n: n > 0))
            agreeing = F.aggregate(seen, start, step, lambda state: state["best"])
            return F.struct(
                F.coalesce(agreeing, F.lit(0)).alias("lines"),
                F.aggregate(counts, F.lit(0), lambda total, n: total + n).alias("total"),
                F.lit(-order).alias("order"),
                F.lit(delimiter).alias("delimiter"),
            )

        counts = F.transform(
            lines, lambda line: F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))
        )
        return let(counts, with_counts)

    def best_of(lines: Column) -> Column:
        return F.array_max(F.array(*[score(lines, i, d) for i, d in enumerate(DELIMITERS)]))

    # Each step is bound, so that no array is made anew for every mention.
    kept = let(F.split(sample, "\n"), lambda lines: F.filter(lines, lambda line: strip(line) != ""))
    return let(let(kept, best_of), lambda best: F.when(best["total"] > 0, best["delimiter"]))


def _pattern(template: str, delimiter: Column) -> Column:
    escaped = F.when(delimiter == "|", F.lit(r"\|")).otherwise(delimiter)
    return F.replace(F.lit(template), F.lit("DLM"), escaped)


def split_records(text: Column, delimiter: Column) -> Column:
    """Array of records; a quoted newline stays inside its record."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), _pattern(_RECORD, delimiter), F.lit(1))


def split_cells(record: Column, delimiter: Column) -> Column:
    """Array of unquoted cells of one record."""
    raw = F.regexp_extract_all(F.concat(delimiter, record), _pattern(_CELL, delimiter), F.lit(1))

    def unquote(cell: Column) -> Column:
        def join(quoted: Column) -> Column:
            inner = F.regexp_replace(F.substring(quoted, F.lit(2), F.length(quoted)), '(?s)^((?:[^"]|"")*+)"$', "$1")
            rest = F.substring(cell, F.length(quoted) + 1, F.length(cell))
            return F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)

        return F.when(cell.startswith('"'), let(F.regexp_extract(cell, f"(?s)^({_OPENED})", 1), join)).otherwise(cell)

    return F.transform(raw, unquote)


def last_line_numbers(records: Column) -> Column:
    """Physical line on which each record ends, aligned with ``records``.

    Linear: mark every physical line with its record, keep the last line of each.
    """
    spans = F.transform(
        records, lambda r, i: F.array_repeat(i, F.length(r) - F.length(F.replace(r, F.lit("\n"), F.lit(""))) + 1)
    )

    def last_of_each(owner: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(owner)),
            lambda line: (line == F.size(owner)) | (F.get(owner, line - 1) != F.get(owner, line)),
        )

    plain = F.sequence(F.lit(1), F.size(records))
    multiline = F.exists(records, lambda r: r.contains("\n"))
    # `transform` over a one-element array evaluates the flattened marks once.
    marked = F.transform(F.array(F.flatten(spans)), last_of_each)[0]
    return F.when(F.size(records) == 0, F.array().cast("array<int>")).when(multiline, marked).otherwise(plain)


def header_score(names: Column) -> Column:
    known = F.array(*[F.lit(word) for word in HEADER_WORDS])
    part = "|".join(word for word in HEADER_WORDS if len(word) >= 4)
    return F.aggregate(
        names,
        F.lit(0),
        lambda total, name: total
        + F.when(F.array_contains(known, name), 2).when(name.rlike(part), 1).otherwise(0),
    )


def _named(cells: Column) -> Column:
    """Distinct normalised names of the non-blank cells."""
    return F.array_distinct(
        F.transform(F.filter(cells, lambda c: strip(c) != ""), normalize_column_name)
    )


def is_blank_record(cells: Column) -> Column:
    return ~F.exists(cells, lambda cell: strip(cell) != "")


def signature(columns: Column, delimiter: Column) -> Column:
    """Identity of a layout."""
    shown_delimiter = F.when(delimiter == "\t", F.lit("\\t")).otherwise(delimiter)
    return F.sha2(
        F.concat(
            F.lit('{"columns": ["'),
            F.array_join(columns, '", "'),
            F.lit('"], "delimiter": "'),
            shown_delimiter,
            F.lit('"}'),
        ),
        256,
    )


def profile_issue(header_at: Column) -> Column:
    """Why a file (encoding, delimiter, columns) can't be read; null for a usable one."""
    usable = F.exists("columns", lambda name: name != "")
    return (
        F.when(F.col("encoding").isNull(), F.lit("unreadable_file"))
        .when(F.col("delimiter").isNull(), F.lit("unknown_format"))
        .when(header_at.isNull() | ~usable, F.lit("missing_minimum_column"))
    )


def profile_files(files: DataFrame) -> DataFrame:
    """One row per file: layout, counts, signature, and the records for extraction.

    ``issue_code`` is null for a usable file. ``records`` holds the non-blank data
    rows as struct(row_number, cells); drop it when only the profile is wanted and
    Catalyst prunes the work.
    """
    decoded = decode_files(files)
    split = (
        decoded.withColumn("delimiter", detect_delimiter(F.col("text")))
        .withColumn("raw", split_records(F.col("text"), F.col("delimiter")))
        .withColumn("lines", last_line_numbers(F.col("raw")))
        .withColumn("cells", F.transform("raw", lambda r: split_cells(r, F.col("delimiter"))))
        .drop("content", "text", "raw")
    )
    def best_header(cells: Column, offset: int) -> Column:
        """struct(score, -position) of the best-scoring record; earlier ones win ties."""
        return F.array_max(
            F.transform(cells, lambda c, i: F.struct(header_score(_named(c)).alias("score"), (-i - offset).alias("at")))
        )

    def first_wide_record(cells: Column, offset: int) -> Column:
        return F.array_min(
            F.filter(
                F.transform(cells, lambda c, i: F.when(F.size(F.filter(c, lambda x: strip(x) != "")) >= 2, i + offset)),
                lambda i: i.isNotNull(),
            )
        )

    def found(cells: Column, offset: int) -> Column:
        scored = let(best_header(cells, offset), lambda b: F.when(b["score"] > 0, -b["at"]))
        return F.coalesce(scored, first_wide_record(cells, offset))

    rest = F.slice("cells", HEADER_FIRST_RECORDS + 1, F.greatest(F.size("cells"), F.lit(1)))
    located = (
        split.withColumn(
            "header_at",
            F.coalesce(
                found(F.slice("cells", 1, HEADER_FIRST_RECORDS), 0),
                F.when(F.size("cells") > HEADER_FIRST_RECORDS, found(rest, HEADER_FIRST_RECORDS)),
            ),
        )
        .withColumn("header", F.get("cells", "header_at"))
        .withColumn("columns", F.transform("header", normalize_column_name))
        .withColumn(
            "records",
            F.filter(
                F.slice(
                    F.transform(
                        F.arrays_zip("lines", "cells"),
                        lambda z: F.struct(z["lines"].alias("row_number"), z["cells"].alias("cells")),
                    ),
                    F.col("header_at") + 2,
                    F.greatest(F.size("cells"), F.lit(1)),
                ),
                lambda r: ~is_blank_record(r["cells"]),
            ),
        )
    )
    width = F.size("columns")
    kept = [c for c in files.columns if c != "content"]
    return located.select(
        *kept,
        "file_id",
        "source_file_hash",
        "encoding",
        "delimiter",
        (F.col("header_at") + 1).alias("header_row_number"),
        "columns",
        F.size("records").cast("bigint").alias("row_count"),
        F.size(F.filter("records", lambda r: F.size(r["cells"]) != width))
        .cast("bigint")
        .alias("irregular_row_count"),
        signature(F.col("columns"), F.col("delimiter")).alias("signature"),
        profile_issue(F.col("header_at")).alias("issue_code"),
        "records",
    )


def explode_records(profiled: DataFrame) -> DataFrame:
    """One row per data record: the file columns plus row_number and cells.

    The outer form keeps Catalyst from copying the parsing expressions into a filter
    below the explode; files without rows are dropped right after it.
    """
    others = [c for c in profiled.columns if c != "records"]
    return (
        profiled.select(*others, F.explode_outer("records").alias("record"))
        .where("record is not null")
        .select(*others, F.col("record.row_number").alias("row_number"), F.col("record.cells").alias("cells"))
    )
