"""Sharding, quality rules and mixing against one-row-at-a-time models."""

import re
import zlib
from collections import Counter

from ledgerloom.llm import mixture, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_match_the_mixture(spark, odd_docs):
    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 3 else f"s{i % 7}") for i in range(500)], "doc_id long, text string, source string")
    got = sharding.interleave(docs, shards=7).collect()
    assert sorted(r.doc_id for r in got) == list(range(500))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    for source in {r.source for r in got}:
        counts = [sum(r.shard == s and r.source == source for r in got) for s in range(7)]
        assert max(counts) - min(counts) <= 4
    odd = sharding.interleave(odd_docs).collect()
    assert len(odd) == 13 and {r.law for r in odd} == {"rows"} and all(r.grown_shard is None for r in odd)
    assert {(r.size, r.text_crc32) for r in odd if r.doc_id == 4} == {(16, zlib.crc32(b""))}
    assert sharding.interleave(odd_docs.limit(0)).collect() == []


def test_quality_counts_and_verdicts(spark, odd_docs):
    junk = [" ".join(f"wo{i}{j}####" for j in range(80)) for i in range(12)] + [" ".join(["again"] * 90)] * 6
    clean = [" ".join(f"word{(i * 31 + j * 17) % 4001}" for j in range(70)) + "." for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(junk + clean + ["a b c a b c\n\n x \n x", None, ""])], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, text in texts.items():
        words = WORD.findall(text)
        seen = Counter(zip(words, words[1:], words[2:]))
        covered = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert not any(rows[i].kept for i in range(18)) and all(rows[i].kept for i in range(18, 78))
    odd = quality.judge(odd_docs).collect()
    assert len(odd) == 13 and not any(r.kept for r in odd if r.n_words == 0)
    assert quality.judge(odd_docs.limit(0)).collect() == []
    assert quality.estimate({}) == {}


def test_mixture_meets_its_targets(spark, odd_docs):
    docs = spark.createDataFrame(
        [(i, " ".join(["w"] * (i % 23)), [None, "b", "a", "c"][i % 4] if i % 50 else "tiny") for i in range(800)], "doc_id long, text string, source string")
    documents, pieces = mixture.mix(docs, block_tokens=16)
    rows = documents.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert r.size == r.doc_id % 23 and 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(capped.values())) / (sum(weight[s] for s in order if s not in capped) or 1)
        more = {s: 2.0 * sizes[s] for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in order:
        own = [r for r in rows if r.source == s]
        assert abs(own[0].target - capped.get(s, level * weight[s])) < 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    slots = sorted(pieces.select("slot", "_key").distinct().collect())
    # Early and late slots hold the same mixture.
    half = Counter(k for _, k in slots[: len(slots) // 2]), Counter(k for _, k in slots[len(slots) // 2 :])
    assert all(abs(half[0][k] - half[1][k]) <= 6 for k in half[0])
    again = {(r.doc_id, r.taken) for r in mixture.mix(docs, block_tokens=16)[0].collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mixture.mixed_documents(docs, block_tokens=16).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in rows)
    odd, _ = mixture.mix(odd_docs)
    assert odd.count() == 13 and odd.filter("size = 0 and taken > 0").count() == 0
    assert mixture.mix(odd_docs.limit(0))[0].collect() == []
