"""Encoding, toxicity, nearest neighbours and tool calls."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, chat, forest, toxicity
from ledgerloom.llm.queries import word_vocabulary


def test_encoding_equals_the_library(spark, odd_docs):
    rng = random.Random(1)
    texts = ["", "Ünï ΑΣ ΣΑΣ İstanbul I'm don't WE'LL 123 ４５ ½ x²  　\x1c\x1d a b", "<|endoftext|>hi<|startoftext|> x<|endoftext|", "été \U0001f600 漢字 \x00\x85​" + "ab" * 3000]
    for _ in range(300):
        texts.append("".join(rng.choice("aabcdeehiinorst 'S.,!\n\té1#<|>ßİΣß") for _ in range(rng.randint(0, 120))))
        texts.append("".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0x3000), rng.randrange(0x1F000, 0x1FB00)])) for _ in range(rng.randint(0, 30))))
    rows = list(enumerate(texts)) + [(r.doc_id, r.text) for r in odd_docs.collect()]
    library = Tokenizer.from_file(word_vocabulary())
    expected = []
    for d, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        expected.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    got = bpe.encode_digests(spark.createDataFrame(rows, "doc_id long, text string"), word_vocabulary()).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    full = bpe.encode(odd_docs, word_vocabulary()).filter("doc_id = 2").first()
    assert full.decoded == library.decode(full.ids, skip_special_tokens=False)
    assert bpe.encode(odd_docs.limit(0), word_vocabulary()).collect() == []


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 4)
    with open(word_vocabulary(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    texts = ["one two three", "four five six seven", "one eight", "two two nine"]
    assert [n for n, _, _ in codec.rows(texts, group_chars=1)] == [3, 4, 2, 3]
    assert len(codec.counts) <= 6


def test_toxicity_on_held_out_texts(spark, odd_docs):
    rng = random.Random(3)
    calm = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "idiot", "grobnaya", "1diot"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, labels[i][1]) for i, r in got.items() if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    odd = toxicity.score(odd_docs, known.limit(0)).collect()
    assert len(odd) == 13 and {(r.score, r.predicted) for r in odd} == {(0.0, 0)}
    assert toxicity.score(odd_docs.limit(0), known.limit(0)).collect() == []
    assert toxicity.describe("", {}) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_keeps_the_share_of_labels(spark):
    """Texts that tell nothing are as toxic as the labels are, however few the sample takes."""
    docs = spark.createDataFrame([(i, " ".join(["grey"] * (5 + i % 3))) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(random.Random(i).random() < 0.2)) for i in range(3000)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, sample_rows=300).collect()
    assert sum(r.score for r in got) / len(got) == pytest.approx(0.2, abs=0.08) and not any(r.predicted for r in got)


def exact(rows, k):
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            far = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = far[:k]
    return out


def test_nearest_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 5
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=8)]) for i in range(3000)]
    rows += [(i, rows[0][1]) for i in range(3000, 3300)]
    bad = [(9000, None), (9100, []), (9200, [0.0] * 8), (9300, [1.0, None] + [0.0] * 6), (9400, [float("nan")] * 8), (9500, [float("inf")] + [1.0] * 7), (9600, [1.0]), (None, rows[1][1])]
    table = spark.createDataFrame(rows + bad + [rows[100]], "vec_id long, embedding array<double>")
    truth = exact(rows, 10)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 200)
    got = {}
    for r in forest.search(table, share=0.2, least=300, trees=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == set(truth)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        hits += len({(v, round(s, 9)) for _, s, v in found} & {(i, round(s, 9)) for s, i in truth[q]})
    assert hits / (10 * len(truth)) >= 0.9
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert sorted((r.rank, r.vec_id) for r in forest.search(few).collect()) == [(n + 1, i) for n, (_, i) in enumerate(exact(rows[:4], 10)[0])]
    assert forest.search(table.limit(0)).collect() == []


@pytest.mark.parametrize("value,schema,found", [
    ({"a": 1}, {"type": "object", "required": ["a", "b"]}, ["/b:required"]),
    ([1, "x"], {"type": "array", "items": {"type": "integer"}}, ["/1:type"]),
    ({"a": 5, "z": 0}, {"properties": {"a": {"maximum": 4, "enum": [1]}}, "additionalProperties": False}, ["/a:enum", "/a:maximum", "/z:additionalProperties"]),
    (True, {"type": "number"}, [":type"]), ("", {"minLength": 1}, [":minLength"]), (2.0, {"type": ["integer", "null"]}, []),
])
def test_schema_violations(value, schema, found):
    assert chat.violations(value, schema) == found


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, 0, "a", "f", '{"x":1}', ["b"]), (1, 1, 0, "b", "f", '{"x":2.0,"a":[1.5,{"z":1,"b":"é"}]}', []), (1, 2, 0, "c", "g", "{bad", ["c"]),
         (1, 3, 0, "d", "f", '{"y":1}', ["c", "zz"]), (2, 0, 0, "a", "f", None, None), (None, 0, 0, "a", "f", None, None), (2, 0, 0, "a", "f", None, None)],
        "conv_id long, turn int, seq int, call_id string, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([(1, 5, "a", "r"), (1, 0, "b", "r"), (1, 6, "a", "q"), (3, 1, "x", "o"), (3, 1, None, "o")], "conv_id long, turn int, call_id string, content string")
    rows = {(r.conv_id, r.call_id): r for r in chat.link(calls, results, {"f": {"type": "object", "required": ["x"]}}).collect()}
    assert {k: (r.position, r.status, r.n_errors) for k, r in rows.items()} == {
        (1, "b"): (0, "early", 0), (1, "a"): (1, "linked", 0), (1, "c"): (2, "cyclic", 1), (1, "d"): (3, "cyclic", 1),
        (2, "a"): (0, "unanswered", 1), (3, "x"): (None, "orphan", 0)}
    assert rows[1, "b"].json == '{"arguments":{"a":[1.5,{"b":"é","z":1}],"x":2},"call_id":"b","errors":[],"name":"f","position":0,"result":"r","status":"early"}'
    messages = spark.createDataFrame(
        [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":"$b"}},{"id":"b","name":"f","arguments":{"x":2}}]}'),
         (1, 1, "tool", '{"tool_call_id":"a","content":"42"}'), (1, 2, "user", "hi"), (1, 3, None, None), (None, None, "user", "x"), (1, 4, "assistant", "{no json")],
        "conv_id long, turn int, role string, text string")
    got = chat.link(*chat.tool_messages(messages), {"f": {"type": "object"}}).collect()
    assert sorted((r.position, r.call_id, r.status) for r in got) == [(0, "b", "unanswered"), (1, "a", "linked")]
    deep = spark.createDataFrame(
        [(1, 0, "assistant", '\n {"tool_calls":[{"id":"a","name":"f","arguments":{"x":{"y":["$b","no $c","\\\\"],"$d":"\\"$e\\""}}},{"id":"b","name":"f","arguments":{"x":"$"}}]}')],
        "conv_id long, turn int, role string, text string")
    assert [sorted(r.depends) for r in chat.tool_messages(deep)[0].orderBy("seq").collect()] == [["b"], [""]]
    assert sorted((r.position, r.call_id) for r in chat.link(*chat.tool_messages(deep), {}).collect()) == [(0, "b"), (1, "a")]
    plain = chat.link(*chat.exchanges(messages), chat.REPLY).collect()
    assert sorted((r.turn, r.status) for r in plain) == [(0, "orphan"), (2, "unanswered"), (4, "orphan")]
    assert chat.link(*chat.exchanges(messages.limit(0)), chat.REPLY).collect() == []
