"""Near duplicates, repeated passages and repeated bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from ledgerloom.llm import components, near, spans, suffix


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(600):
        letters = rng.choice([2, 5, 100])
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randrange(letters) for _ in range(rng.randint(0, 2))]
        x, y, true = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), subsequence(a, b)
        assert near.aligned(x, y, true) == near.aligned(x, y, 0) == true
        if a and b:
            share = true / (len(a) + len(b) - true)
            assert near.similarity(x, y) == (share if share >= 0.8 else 0.0)


def near_model(rows):
    texts = sorted({t for _, t in rows if t and t.strip()})
    runs = dict(zip(texts, near.shingles(texts), strict=True))
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, s in enumerate(texts):
        for t in texts[i + 1 :]:
            if near.similarity(runs[s], runs[t]):
                root[find(s)] = find(t)
    groups = {}
    for d, t in rows:
        if t in root and d is not None:
            groups[find(t)] = min(d, groups.get(find(t), d))
    return sorted(((d, groups.get(find(t)) if t in root else d) for d, t in rows), key=str)


def test_near_duplicates(spark, odd_docs, monkeypatch):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(150):
        words = list(base[i % 6])
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base[0][:60] + [f"y{i}{j}" for j in range(60)])) for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near_model(rows)
    assert sorted(((r.doc_id, r.class_id) for r in near.classes(docs).collect()), key=str) == expected
    # Nearly all buckets count as large: hubs and neighbours have to do.
    monkeypatch.setattr(near, "SMALL_BUCKET", 2)
    assert sorted(((r.doc_id, r.class_id) for r in near.classes(docs).collect()), key=str) == expected
    odd = near.classes(odd_docs)
    got = odd.collect()
    assert len(got) == 13
    told = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == near_model(told)
    assert {r.class_size for r in got if r.doc_id in (1, 2, 3)} == {4}
    assert near.representatives(odd_docs, ["lang"]).count() == 9
    assert near.classes(odd_docs.limit(0)).collect() == []


def test_near_duplicates_of_short_texts_and_of_signs(spark):
    """Texts of eight and nine words, similarity exactly 0.8, and copies without a word."""
    rows = []
    for i in range(1500):
        words = [f"s{i}_{j}" for j in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "end"]))]
    rows += [(9000 + i, "!!! ### $$$") for i in range(3)] + [(9010, "..."), (9011, "... "), (9012, " "), (9013, " "), (9014, "")]
    got = {r.doc_id: (r.class_id, r.kept) for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1][0] == got[2 * i][0] == 2 * i for i in range(1500))
    assert [got[9000 + i] for i in range(3)] == [(9000, True), (9000, False), (9000, False)]
    assert all(got[i] == (i, True) for i in range(9010, 9015))


def test_near_duplicates_within_a_template(spark):
    """Pairs at 0.8 or just above in a family whose other members, hubs too, are just below."""
    template, rows = [f"t{i}" for i in range(200)], []
    for i in range(200):
        words = template[:196] + [f"o{i // 2}_{j}" for j in range(4)]
        words[80:97] = [f"x{i}_{j}" for j in range(17)]
        rows.append((i, " ".join(words)))
    expected = near_model(rows)
    assert expected == sorted(((i, i - i % 2) for i in range(200)), key=str)
    got = near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 202), (200, 202), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {i: 200 for i in (200, 201, 202)}
    assert {r.node: r.root for r in got} == expected and len(got) == len(expected)
    some = components.components(spark.createDataFrame(edges[5:], "a long, b long"))
    for more in (edges[:5] + [(6, 5), (300, 301)], [(59, 60)], [(250, 60), (0, 201), (170, 99)]):
        edges += more
        some = components.extended(some, spark.createDataFrame(more, "a long, b long"))
        whole = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        got = [tuple(r) for r in some.select("node", "root").collect()]
        assert set(got) == whole and len(got) == len(whole)


def test_repeated_passages(spark, odd_docs):
    assert all("".join(spans.sentences(t)) == t for t in ("", " \n a. b", "x, " * 60, "é…\n\n«q». w" * 9))
    rng = random.Random(5)
    pool = [" ".join(f"p{rng.randrange(90)}" for _ in range(rng.randint(1, 14))) + rng.choice([". ", ".\n", ", "]) for _ in range(60)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.3 else "".join(pool[j : j + 6]) for j in (rng.randrange(54), rng.randrange(54)))) for i in range(80)]
    first, kept = {}, {}
    for i, text in rows:
        for a, _, words in spans.runs(spans.sentences(text)):
            first.setdefault(words, (i, a))
    for i, text in rows:
        units = spans.sentences(text)
        gone = {j for a, e, words in spans.runs(units) if first[words] != (i, a) for j in range(a, e)}
        kept[i] = "".join(u for j, u in enumerate(units) if j not in gone)
    got = spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == kept
    odd = spans.remove_repeated(odd_docs, carry=["lang", "id"])
    assert odd.count() == 13 and odd.filter("doc_id = 1").first().n_removed == 0
    assert odd.filter("doc_id = 2").first().text == "Intro words here.\nOutro."
    assert [r.text for r in odd.filter("doc_id = 3").collect()] == ["", ""] and {r.id for r in odd.collect()} == {1}
    assert spans.remove_repeated(odd_docs.limit(0)).collect() == []


def test_passages_of_repeated_rows_and_long_rows_of_signs(spark):
    passage = " ".join(f"Word{i} of the passage number {i} here." for i in range(12))
    rows = [(None, passage)] * 3 + [(4, passage)] * 2 + [(5, passage + " More.")] + [(6, "x " + "." * 1_000_000 + "a"), (7, None), (7, None), (8, "\n" * 100_000 + passage)]
    got = [(r.doc_id, r.text) for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(t for d, t in got if d is None) == ["", "", passage]
    assert [t for d, t in got if d == 4] == ["", ""] and (5, "More.") in got
    assert (6, rows[6][1]) in got and got.count((7, None)) == 2 and [t.strip() for d, t in got if d == 8] == [""]


def every_run(units):
    """All runs of at least three sentences and 25 words: first, end, words compared."""
    words = [u.lower().split() for u in units]
    for a in range(len(units)):
        for e in range(a + 3, len(units) + 1):
            if words[a] and sum(map(len, words[a:e])) >= 25:
                yield a, e, "\n".join(" ".join(w) for w in words[a:e])


def test_all_sentences_of_repeated_passages(spark):
    rng = random.Random(9)
    pool = [" ".join(f"p{i}_{j}" for j in range(rng.choice([3, 5, 9, 14]))) + ". " for i in range(60)]
    told = ["".join(f"w{j} " for j in range(n)).strip() + ". " for n in (16, 8, 5, 5, 5)]
    rows = [(0, "".join(told)), (1, "".join(told))]
    for i in range(2, 60):
        at, n = rng.randrange(52), rng.randint(3, 8)
        rows.append((i, f"Own {i} start. " + "".join(pool[at : at + n]) + f"Own {i} end."))
    first, kept = {}, {}
    for i, text in rows:
        for a, _, words in every_run(spans.sentences(text)):
            first.setdefault(words, (i, a))
    for i, text in rows:
        units = spans.sentences(text)
        gone = {j for a, e, words in every_run(units) if first[words] != (i, a) for j in range(a, e)}
        kept[i] = "".join(u for j, u in enumerate(units) if j not in gone)
    got = {r.doc_id: r.text for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "" and got == kept


def test_passages_inside_long_sentences(spark):
    """Passages at any offset of unpunctuated lines, and in a script without blanks."""
    rng = random.Random(10)
    rows, lost = [], []
    for i in range(40):
        passage = [f"p{i}_{rng.randrange(500)}" for _ in range(60)]
        for j in range(2):
            before, after = ([f"o{i}_{j}_{rng.randrange(500)}" for _ in range(rng.randint(17, 40))] for _ in range(2))
            rows.append((2 * i + j, " ".join(before + passage + after)))
    solid = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(90))
    rows += [(100, "".join(chr(0x6E00 + rng.randrange(4000)) for _ in range(23)) + solid), (101, "".join(chr(0x7E00 + rng.randrange(4000)) for _ in range(30)) + solid)]
    rows += [(102, " ".join(["ha", "ho"] * 100)), (103, "he " + " ".join(["ha", "ho"] * 100))]
    assert all("".join(spans.sentences(t)) == t for _, t in rows)
    told = dict(rows)
    got = {r.doc_id: r.text for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == told[i] for i in range(0, 80, 2))
    for i in range(1, 80, 2):
        lost.append(len(told[i].split()) - len(got[i].split()))
    assert max(lost) <= 60 and sum(n > 0 for n in lost) >= 38 and sum(lost) / len(lost) > 40
    assert got[100] == told[100] and len(told[101]) - len(got[101]) > 60
    assert len(got[103].split()) < 60


def test_suffix_arrays():
    rng = random.Random(6)
    for it in range(150):
        s = [rng.randint(1, rng.choice([1, 2, 3, 300])) * (700 if it % 5 == 0 else 1) for _ in range(rng.randint(1, 60))] + [0]
        assert suffix.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def bytes_model(rows, length):
    counts, out = Counter(), []
    for _, text in rows:
        b = (text or "").encode()
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_repeated_bytes(spark, odd_docs):
    rng = random.Random(2)
    parts = ["".join(rng.choice("abc é") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(120):
        tail = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice([None, i]), rng.choice([None, "", *["x" * rng.randint(0, 30) + parts[rng.randrange(4)][rng.randint(0, 9) :] + tail + parts[0]] * 9])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # The second form splits the groups of every common anchor.
    for options in ({}, {"group_bytes": 300, "shard_bytes": 1000}):
        got = sorted(map(tuple, suffix.digests(docs, length=20, k=6, **options).collect()), key=str)
        assert got == bytes_model(rows, 20)
    told = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, suffix.digests(odd_docs).collect()), key=str) == bytes_model(told, 200)
    assert suffix.digests(odd_docs.limit(0)).collect() == []
