"""Byte-pair encoding over a trie of distinct words: shared prefixes are encoded once."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIALS = ("<|startoftext|>", "<|endoftext|>")
#: Words whose encoding a task keeps between batches.
KEPT_WORDS = 400_000
OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL_OUTPUT = "doc_id long, ids array<int>, decoded string"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """A word-level BPE vocabulary; encodes sets of words by one walk over their trie.

    Tokens are numbered by merge order: symbols first, then each merge's result, so a smaller
    number merges earlier. `last` of a prefix is the last token of its encoding. The encoding of a
    prefix is that of a shorter prefix followed by one token, exactly if the two tokens around the
    cut stay apart when both are taken to pieces and merged anew; so `last` of a prefix follows
    from `last` of shorter ones, and words that share a prefix share all of its states.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        symbols = sorted((t for t in vocabulary if t not in made), key=vocabulary.get)
        self.rank = {t: i for i, t in enumerate(symbols)}
        self.left, self.right = list(range(len(symbols))), list(range(len(symbols)))
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            self.rank[a + b] = token = len(self.left)
            self.left.append(self.rank[a])
            self.right.append(self.rank[b])
            self.joined[self.rank[a], self.rank[b]] = token
        self.symbols = len(symbols)
        self.text = sorted(self.rank, key=self.rank.get)
        self.ids = [vocabulary[t] for t in self.text]
        plain = {t: (t.removesuffix(self.suffix), t.endswith(self.suffix) and len(t) > len(self.suffix)) for t in self.rank}
        self.inner = {t: self.rank[t] for t, (_, closes) in plain.items() if not closes}
        self.closing = {p: self.rank[t] for t, (p, closes) in plain.items() if closes}
        self.length = [len(plain[t][0]) for t in self.text]
        self.longest = max(self.length)
        self.endings = {closes: self._endings(table) for closes, table in ((False, self.inner), (True, self.closing))}
        self.apart = lru_cache(maxsize=1 << 18)(self._apart)
        self.byte_letter = byte_letters()

    @staticmethod
    def _endings(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """Up to three letters -> lengths, longest first, of the tokens that may end in them."""
        lengths: dict[str, set[int]] = {}
        for p in table:
            lengths.setdefault(p[-3:], set()).add(len(p))
        short = {tail: n for tail, n in lengths.items() if len(tail) < 3}
        for tail, n in lengths.items():
            n.update(*(short[tail[i:]] for i in (1, 2) if tail[i:] in short))
        return {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items()}

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens a, b next to each other stay two tokens when merged from symbols."""
        limit = len(self.left)
        while True:
            whole = self.joined.get((a, b))
            if whole is not None and whole < limit:
                return False
            if a > b:
                if a < self.symbols:
                    return True
                limit, a = a, self.right[a]
            else:
                if b < self.symbols:
                    if a < self.symbols:
                        return True
                    limit, a = a, self.right[a]
                else:
                    limit, b = b + 1, self.left[b]

    def _step(self, tail: str, last: list[int], size: int, closes: bool) -> int:
        """Last token of the encoding of a prefix of `size` letters, the newest of which are `tail`.

        last[i]: that of the prefix of i letters.
        """
        table, lengths = self.closing if closes else self.inner, self.endings[closes]
        end, held = tail[-3:], len(tail)
        for n in lengths.get(end) or lengths.get(end[-2:]) or lengths[end[-1]]:
            if n <= held:
                token = table.get(tail[held - n :])
                if token is not None and (n == size or self.apart(last[size - n], token)):
                    return token
        raise KeyError(f"no token ends {tail!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """word (in byte letters) -> its tokens by merge order, from one depth-first walk of a trie.

        The last letter of a word carries the word end, so it is a leaf of its own kind.
        """
        root: dict = {}
        for word in words:
            node = root
            for letter in word[:-1]:
                below = node.get(letter)
                if below is None:
                    below = node[letter] = {}
                node = below
            node.setdefault("", []).append(word)
        found: dict[str, list[int]] = {}
        last, step, longest = [-1], self._step, self.longest
        todo: list[tuple[int, str, dict]] = [(0, "", root)]
        while todo:
            size, tail, node = todo.pop()
            if size:
                del last[size:]
                last.append(step(tail, last, size, False))
            for letter, below in node.items():
                if letter:
                    todo.append((size + 1, (tail + letter)[-longest:], below))
                else:
                    for word in below:
                        found[word] = self._unwind(last, size + 1, step((tail + word[-1])[-longest:], last, size + 1, True))
        return found

    def _unwind(self, last: list[int], size: int, end: int) -> list[int]:
        tokens, at, length = [end], size - self.length[end], self.length
        while at:
            tokens.append(last[at])
            at -= length[last[at]]
        return tokens[::-1]


#: What a text is cut into, for texts of common Latin letters and signs; white space is dropped.
_COMMON = r"\t\n\x0b\x0c\r -~\xa0¡¿«»·À-ÖØ-öø-ıĴ-ńŊ-žƒ–—‘’“”„…€"
_ODD = re.compile(f"[^{_COMMON}]")
_LETTER = "a-zß-öø-žƒ"
_CUT = re.compile(rf"[{_LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTER}0-9]+")
_SPECIAL = re.compile("(" + "|".join(re.escape(s) for s in SPECIALS) + ")")


class Cutter:
    """Words of a text as the vocabulary sees them; special tokens stay whole.

    Texts with other letters than common Latin ones are normalised and cut by the tokenizer file's
    own rules, whose Unicode tables differ from Python's.
    """

    def __init__(self, spec_text: str):
        from tokenizers import Tokenizer

        rules = Tokenizer.from_str(spec_text)
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        self.letters = byte_letters()

    def cut(self, text: str) -> list[str]:
        if "<|" in text:
            parts = _SPECIAL.split(text)
            if len(parts) > 1:
                return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [BYTES + w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return _CUT.findall(text.lower())

    def spell(self, word: str) -> str:
        """A word in byte letters."""
        if word.isascii() and word.isprintable():
            return word
        if word[0] == BYTES:
            return word[1:]
        return "".join(self.letters[b] for b in word.encode())


#: Marks a word that is spelled in byte letters already.
BYTES = "\0"


class Codec:
    """Word -> (number of tokens, ids as bytes, decoded text), remembered up to KEPT_WORDS words."""

    def __init__(self, spec_text: str):
        self.encoder = Encoder(json.loads(spec_text))
        self.cutter = Cutter(spec_text)
        self.counts: dict[str, int] = {}
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered.

        When there are too many, the half that came first stays: common words come early.
        """
        missing = words.difference(self.counts)
        if len(self.counts) + len(missing) > KEPT_WORDS:
            keep = [*islice(self.counts, KEPT_WORDS // 2)]
            self.counts, self.ids, self.decoded = ({w: table[w] for w in keep} for table in (self.counts, self.ids, self.decoded))
            missing = words.difference(self.counts)
        enc, spell = self.encoder, self.cutter.spell
        spelled: dict[str, list[str]] = {}
        for w in missing:
            if w in enc.specials:
                self._put(w, [enc.specials[w]], w)
            else:
                spelled.setdefault(spell(w), []).append(w)
        for s, tokens in enc.encode_words(spelled).items():
            ids, text = [enc.ids[t] for t in tokens], " ".join([enc.text[t] for t in tokens])
            for w in spelled[s]:
                self._put(w, ids, text)

    def _put(self, word: str, ids: list[int], text: str) -> None:
        self.counts[word] = len(ids)
        self.ids[word] = struct.pack(f"<{len(ids)}I", *ids)
        self.decoded[word] = text

    def rows(self, texts: list[str | None], group_chars: int = 1_000_000) -> Iterator[tuple[int, bytes, str]]:
        """Per text: number of tokens, ids as little-endian words, decoded text."""
        group: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(self.cutter.cut(text or ""))
            size += len(text or "")
            if size >= group_chars or i + 1 == len(texts):
                self.learn(set().union(*group))
                for words in group:
                    yield (
                        sum(map(self.counts.__getitem__, words)),
                        b"".join(map(self.ids.__getitem__, words)),
                        " ".join(map(self.decoded.__getitem__, words)),
                    )
                group, size = [], 0


@lru_cache(maxsize=1)
def _codec(spec_text: str) -> Codec:
    return Codec(spec_text)


def _read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _run(spec, columns, names):
    """Encode batches; columns(rows) gives the arrays of the named columns after doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            rows = codec.rows(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns(rows)], names=["doc_id", *names])

    return run


def _digests(spec):
    def columns(rows):
        out = [(n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for n, ids, text in rows]
        return [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _run(spec, columns, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _full(spec):
    def columns(rows):
        out = [(np.frombuffer(ids, dtype="<u4").astype("int32"), text) for _, ids, text in rows]
        return [pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.string())]

    return _run(spec, columns, ["ids", "decoded"])


def _apply(docs: DataFrame, vocabulary: str, make, schema: str) -> DataFrame:
    # The vocabulary is one file of fixed size, so every task may hold it.
    spec = docs.sparkSession.sparkContext.broadcast(_read_spec(vocabulary))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make(spec), schema)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; no shuffle.

    Null texts count as empty: no tokens, digests of nothing. Null and repeated doc_ids keep their
    rows. Special tokens written out in a text are single tokens. Other columns are ignored. An
    empty table gives none.
    """
    return _apply(docs, vocabulary, _digests, OUTPUT)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded text of every whole text; cases as in encode_digests."""
    return _apply(docs, vocabulary, _full, FULL_OUTPUT)
