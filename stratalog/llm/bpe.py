"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one encoding, and that encoding has one last token. It is the only token that
(a) ends the prefix, (b) is reached by the merges when its own bytes are encoded, and (c) stays apart
from the last token of the prefix before it: merging the two alone gives back the pair. An automaton
over the vocabulary names the tokens that end each prefix, (c) is tested on the pair, and the last token
of each prefix is stored. Following these back from the end emits the exact ids, with no merge loop.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratalog.llm.common import documents, ship
from stratalog.llm.tokens import UnitMemory, tokenizer, vocabulary_path

# Fixed value: how a byte-level tokenizer of this family cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts up to U+024F, where the letters, numbers and white space can be spelled out.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = r"\t-\r \x85\xa0"
LATIN_WORDS = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
PAIRS_KEPT = 500_000  # pairs whose result a worker remembers; this only saves time


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def word_finder(path: str):
    """A function from a text to its words.

    Characters beyond ``LATIN_WORDS`` are letters, numbers, white space or others by the Unicode version of
    the library, so its own pre-tokenizer says what each is, once. Another character of that kind stands
    for it while the text is cut.
    """
    beyond, latin = re.compile(r"[^\x00-\u024f]").search, re.compile(LATIN_WORDS).findall
    cut = tokenizer(path).pre_tokenizer.pre_tokenize_str
    kinds: dict[int, str] = {}

    def kind(c: str) -> str:
        for before, same in (("a", "\xe9"), ("1", "\xb2"), ("!", "\xa4")):  # a letter, a number, neither
            if len(cut(before + c)) == 1:
                return same
        return "\x85"  # white space

    def words(text: str) -> list[str]:
        if beyond(text) is None:
            return latin(text)
        for c in set(text):
            if c > "\u024f" and ord(c) not in kinds:
                kinds[ord(c)] = kind(c)
        ends = list(accumulate(map(len, latin(text.translate(kinds)))))
        return [text[start:end] for start, end in zip([0, *ends], ends)]

    return words


class PrefixEncoder:
    """Encodes and decodes by the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        ids = model["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.words = word_finder(path)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        size = max([*ids.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        for text, i in special.items():
            self.bytes[i] = text.encode()
        self.decimal = [str(i) for i in range(size)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * size  # rank of the merge that makes a token; -1 for single bytes
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size
        for rank, (left, right) in enumerate(merges):
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, rank)
            if self.made[whole] < 0:
                self.made[whole], self.parts[whole] = rank, pair
        self.length = [len(b) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for i in ids.values():
            if self.made[i] < 0 or self.apart(*self.parts[i], self.made[i]):
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.word = UnitMemory(lambda new: list(map(self.encode_word, new)))

    def apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge over the border of two tokens comes before the merge of rank ``until``.

        The merges on both sides are undone from the last to the first. Between two of them the tokens
        that touch the border stay as they are, and a merge of these would happen if it ranks before
        the one undone; at equal rank the place further left goes first.
        """
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and crossing < until:
                return False
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                until, left = a, self.parts[left][1]
            else:
                until, right = b + 1, self.parts[right][0]

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode().decode("latin-1")  # one character for each byte
        last = [0] * len(data)
        pairs, end_of = self.pairs, self.automaton.iter(data)
        length, never = self.length, len(self.rank) + 1
        found = -1
        for end, token in end_of:
            if end == found:
                continue
            before = end - length[token]
            if before >= 0:
                pair = last[before] << 20 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    fits = pairs[pair] = self.apart(last[before], token, never)
                if not fits:
                    continue
            last[end] = token
            found = end
        ids, at = [], len(data) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable(self.word(self.words(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """Unknown ids raise an error; bytes that are no text become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encoded(
    docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, ids, decoded``: the ids of each whole text and the text that they decode to.

    A null or empty text has no ids and decodes to an empty text. Special strings in a text become their
    ids, as the library does by default. Rows that repeat or have a null id are encoded like any other.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            for doc, whole in zip(batch.column(0), batch.column(1).to_pylist()):
                ids = own.encode(whole or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()], batch.schema[0].type), pa.array([ids], pa.list_(pa.int32())),
                     pa.array([own.decode(ids)])],
                    names=["doc_id", "ids", "decoded"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")


def encoding_digests(
    docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of what ``encoded`` returns.

    They are taken where the ids are made, so no ids leave the worker. Nothing is shuffled.
    """
    ship(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for whole in batch.column(1):
                ids = own.encode(whole.as_py() or "")
                counts.append(len(ids))
                joined = ",".join(map(own.decimal.__getitem__, ids))
                id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(counts, np.int64)),
                 pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir))
