"""Files split over tasks by byte range, next to the reader that holds a file in one row."""

import random

import pytest

from ledgerloom.sources import files, ranges
from ledgerloom.sources.store import stage_shared

COMPARED = ["path", "encoding", "delimiter", "header_row_number", "columns", "row_count", "irregular_row_count", "signature", "issue_code"]


def _cell(rng, delimiter):
    plain = rng.choice(["12,50", "Café", "2026-01-02", "x", "", " ", 'say "hi"', "é" * 9, "1;2"])
    kind = rng.randrange(8)
    if kind == 0:
        return '"' + plain.replace('"', '""') + '"'
    if kind == 1:
        return '"first\nsecond ' + delimiter + '""third"""'
    if kind == 2:
        return '"' + "\n".join(["long"] * rng.randrange(30)) + '" tail'
    return plain.replace(delimiter, " ").lstrip('"')


def _file(rng, kind):
    delimiter = rng.choice(",;\t|")
    lines = [rng.choice(["", "Extrato", "note", "a b"]) for _ in range(rng.choice([0, 2, 45]))]
    lines.append(delimiter.join(rng.choice([["Data", "Valor", "Saldo"], ["data", "historico", "docto"], ["aa", "bb", "cc"]])))
    lines += [delimiter.join(_cell(rng, delimiter) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(rng.randrange(60))]
    text = rng.choice(["\n", "\r\n", "\r", "\n\r"]).join(lines) + rng.choice(["", "\n", "\r"])
    if kind == "unclosed":
        at = rng.randrange(len(text))
        text = text[:at] + delimiter + '"' + text[at:]
    if kind == "bad":
        return text.encode() + b"\x81\xff"
    if kind == "nul":
        return text.encode() + b"\x00"
    if kind == "plain":
        return b"nothing to part here\nor here\n" * 9
    if kind == "bom":
        return b"\xef\xbb\xbf" + text.encode()
    return text.encode("cp1252" if kind == "cp1252" else "utf-8")


@pytest.fixture()
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _rows(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_ranges_give_what_whole_files_give(spark, tmp_path, small_blocks, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ranges, "BROADCAST_BLOCKS_MAX", 0)
    rng = random.Random(11 + broadcast)
    for i in range(24):
        kind = rng.choice(["utf8", "utf8", "cp1252", "unclosed", "unclosed", "bad", "nul", "plain", "bom"])
        (tmp_path / f"{i}-{kind}.csv").write_bytes(_file(rng, kind))
    path = f"file:{tmp_path}"
    stored = stage_shared(files.profile_files(files.read_files(spark, path)), "whole")
    listing = files.list_files(spark, path).where("length > 0")
    profiles, records = ranges.profile_ranges(spark, path, listing, stage_shared)
    assert ranges.read_lines(spark, path).select("uri", "block").distinct().count() > 60
    assert _rows(profiles, COMPARED) == _rows(stored, COMPARED)
    assert _rows(records, ["path", "row_number", "cells"]) == _rows(files.explode_records(stored), ["path", "row_number", "cells"])
    assert records.count() > 100


def test_content_identity_does_not_depend_on_blocks(spark, tmp_path, small_blocks):
    text = 'data;valor\n"a\nb";1\n' + "2026-01-01;5\r\n" * 50
    for name, content in (("a.csv", text), ("b.csv", text), ("c.csv", text.replace("5", "6", 1)), ("d.csv", text + "x")):
        (tmp_path / name).write_text(content, newline="")

    def hashes():
        path = f"file:{tmp_path}"
        profiles, _ = ranges.profile_ranges(spark, path, files.list_files(spark, path), stage_shared)
        return {r.path[-5:]: r.source_file_hash for r in profiles.collect()}

    small = hashes()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    assert hashes() == small and small["a.csv"] == small["b.csv"] and len(set(small.values())) == 3
