"""Spelling variants, periodic runs and token files next to plain models."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import periodic, spelling, token_files
from ledgerloom.llm.queries import word_vocabulary

DOCS = "doc_id long, text string, word string, id long, n long"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 7, None) for d, t in rows], DOCS).repartition(5)


# --- spelling variants -----------------------------------------------------------------------


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _variants(rows, changed):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if changed and doc is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if _one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 10 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def _found(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _word(rng, letters, size):
    return "".join(rng.choice(letters) for _ in range(size))


@pytest.mark.parametrize("letters", ["ab", "abcdé", "etaoinshrdluÿ×"])
def test_variants_are_those_of_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    base = [_word(rng, letters, rng.randrange(7, 12)) for _ in range(40)]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 40])
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            words += [v, v.upper()] * rng.choice([1, 3])
            words += [v[:-1] + rng.choice(letters)] * 2
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "9", "\n"]).join(words[i::30])) for i in range(30)]
    assert _found(spelling.variants(_docs(spark, rows))) == _variants(rows, False)
    assert _found(spelling.variants(_docs(spark, rows), changed=True)) == _variants(rows, True)


def test_variants_of_odd_texts(spark):
    long = "ab" * 3000
    rows = [(None, "colourful colourful"), (None, "colourful colorful COLORFUL"), (1, None), (2, ""), (3, "12 34 ... 中文"), (4, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa"), (4, "aaaaaaa"), (4, "aaaaaaa")]
    rows += [(5, f"{long} {long} {long}a {long}a"), (6, " ".join(["chained"] * 2 + ["chainede"] * 20 + ["chaineder"] * 200))]
    assert _found(spelling.variants(_docs(spark, rows))) == _variants(rows, False)
    assert spelling.variants(_docs(spark, [])).count() == 0
    assert spelling.variants(_docs(spark, [(1, "short words")])).count() == 0


# --- periodic runs ---------------------------------------------------------------------------


def _runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def _periodic_words(rng):
    words = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.choice([0, 1, 23, 24, 60, 300]))]
    for _ in range(rng.randrange(4)):
        if words:
            a, q = rng.randrange(len(words)), rng.randrange(1, max(2, len(words) // 3))
            unit = words[a : a + q]
            if rng.random() < 0.5 and len(unit) > 4:
                part = unit[: rng.randrange(1, 4)]
                unit = (part * (len(unit) // len(part) + 1))[: len(unit) - 1] + ["x"]
            words[a:a] = (unit * rng.randrange(2, 12))[: rng.randrange(1, 1500)]
    return words[:1200]


def test_runs_are_those_of_all_periods():
    rng = random.Random(3)
    texts = [_periodic_words(rng) for _ in range(400)]
    numbers = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    expected = [_runs(t) for t in texts]
    assert sum(map(len, expected)) > 200
    for at in range(0, len(texts), 80):
        assert periodic.find_runs([np.array([numbers[w] for w in t], np.int64) for t in texts[at : at + 80]]) == expected[at : at + 80]


def test_long_periods_and_long_texts():
    unit = np.random.default_rng(1).integers(0, 500, 40_000)
    assert periodic.find_runs([np.tile(unit, 4)[:-7], np.zeros(200_000, np.int64)]) == [[(0, 159_993, 40_000)], [(0, 200_000, 1)]]


def _digests(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    if doc is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *one, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digests_of_runs(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", "  \x0b"]).join(_periodic_words(rng))) for i in range(120)]
    rows += [(None, "a b " * 30), (None, None), (-5, ""), (7, None), (7, " \t"), (8, "a\x1cb c d " * 20), (8, "a\x1cb c d " * 20), (9, "中 " * 40), (10, "one")]
    got = [tuple(r) for r in periodic.run_digests(_docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((_digests(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 50
    assert periodic.run_digests(_docs(spark, [])).count() == 0


def test_collapsed_texts(spark):
    rows = [(1, "x " + "a b c " * 10 + "y"), (2, "no runs here"), (3, None)]
    got = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in periodic.collapse(_docs(spark, rows)).collect()}
    assert got == {1: ("x a b c y", [(1, 30, 3)]), 2: ("no runs here", []), 3: ("", [])}


# --- token files -----------------------------------------------------------------------------

PIECES = list("abcXYZ019.,;:!?'\"-<|>() \t\n\x0b\x0c\r\x1c\x85\xa0́̌İΣب中\U0001f600éß;jJ") + ["<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", " . ", "end.", "don't."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture(scope="module")
def token_rows():
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choice(PIECES) for _ in range(rng.randrange(80)))) for i in range(1500)]
    return [*rows, (None, "none"), (None, None), (3, "again"), (3, "again"), (-4, ""), (99_999, "a" * 30_000), (99_998, "word. " * 20_000)]


def _expected(tokenizer, rows):
    """Rows by doc_id, nulls first, with ids; those of one doc_id in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]


def test_digests_of_written_tokens(spark, tokenizer, token_rows):
    got = sorted((tuple(r) for r in token_files.written_digests(_docs(spark, token_rows), word_vocabulary()).collect()), key=lambda r: r[1])
    expected = _expected(tokenizer, token_rows)
    assert [r[0] for r in got] == [d for d, _ in expected]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((d, len(ids), crc(ids)) for d, ids in expected), key=str)
    assert token_files.written_digests(_docs(spark, []), word_vocabulary()).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_and_selective_reads(spark, tokenizer, token_rows, tmp_path, encoding):
    path = f"file://{tmp_path}/out"
    unique = [r for r in token_rows if r[0] is not None and r != (3, "again")]
    token_files.write_tokens(_docs(spark, unique), word_vocabulary(), path, ids_encoding=encoding, row_group_bytes=20_000, page_rows=100)
    ids = [i for _, some in _expected(tokenizer, unique) for i in some]
    for first, end in ((0, 10), (777, 20_000), (len(ids) - 5, len(ids) + 9), (5, 5), (len(ids), len(ids) + 3)):
        rows = sorted(token_files.read_window(spark, path, first, end).collect(), key=lambda r: r.start)
        assert [i for r in rows for i in r.ids] == ids[first:end]
        assert not rows or rows[0].start == first
    some = token_files.read_tokens(spark, path).filter("doc_id between 30 and 90").select("doc_id", "n_tokens")
    assert some.count() == 21
    plan = some._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema: ", 1)[1].split("\n")[0] and "GreaterThanOrEqual(doc_id,30)" in plan
    files = [pq.ParquetFile(f).metadata for f in Path(tmp_path, "out/tokens").glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    columns = {c.path_in_schema: c for c in map(groups[0].column, range(5))}
    assert all(c.has_offset_index and c.has_column_index for name, c in columns.items() if not name.startswith("ids"))
    assert columns["ids.list.element"].has_offset_index
    assert ("RLE_DICTIONARY" in columns["ids.list.element"].encodings) == (encoding == "dictionary")
    assert "DELTA_BINARY_PACKED" in columns["start"].encodings
    assert len(groups) > len(files)
    with pytest.raises(ValueError):
        token_files.write_tokens(_docs(spark, unique), word_vocabulary(), path, ids_encoding="plain")


def test_pieces_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 12)
    with open(word_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    pieces, plain = token_files.Pieces(spec), Tokenizer.from_str(spec)
    groups = [["café. été, on", "one Ímã!"], ["café on it's", None], ["two three four five, six"], ["on café née; x"], ["seven on two Ö?! ó.", ""]]
    learned, learn = [], pieces._learn
    monkeypatch.setattr(pieces, "_learn", lambda words: learned.extend(words) or learn(words))
    for group in groups:
        ids, bounds = pieces.encode(pa.array(group, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in group]
    # Signs after accented letters are pieces of their own; what was met twice is learned once.
    assert "café." not in learned and learned.count("café") == 1 == learned.count("on")
