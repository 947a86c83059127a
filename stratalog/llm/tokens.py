"""Tokenizer files, and cutting texts where a byte-level tokenizer cuts them anyway."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

VOCABULARY = "byte_bpe_50k.json"
END_OF_TEXT = 0  # id that closes a packed document

# A word, punctuation or number never reaches over a blank, and the blank opens what follows. So a text
# may be cut before a blank that has no white space on either side: both parts are tokenised as before.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(path: str | None) -> str:
    """``path``, or where the installed public tokenizer files have the default one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, one for each worker, without truncation, padding or threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def safe_pieces(text: str, most: int) -> list[str]:
    """``text`` in pieces of about ``most`` characters; longer where no safe boundary is near."""
    pieces, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + max(most - 1, 1))
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def units(text: str) -> list[str]:
    """``text`` cut before every blank that has no white space on either side.

    That blank is left out, so each unit but the first stands for one blank and itself. What a tokenizer
    gives for a text is what it gives for its units, one after the other. Texts repeat most of theirs.
    """
    pieces = text.split(" ")
    if "" in pieces or any(s in text and (" " + s in text or s + " " in text) for s in _SPACES):
        return _SAFE.split(text)
    return pieces


class UnitMemory:
    """What a worker remembers of the units it has met; this only saves time.

    Units of more than ``LONGEST`` characters are not kept. Of the others there are two generations of at
    most ``KEPT``: when the younger one is full it becomes the older one, and what is met again comes back.
    With their values these stay under a few hundred bytes a unit.
    """

    LONGEST = 48
    KEPT = 250_000

    def __init__(self, learn):
        self.learn = learn  # from a list of units to a list of what is remembered of them
        self.known: dict = {}
        self.older: dict = {}

    def __call__(self, found: list[str]) -> list:
        if len(self.known) >= self.KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for unit in set(found).difference(known):
            if unit in older:
                known[unit] = older[unit]
            else:
                new.append(unit)
        if not new:
            return list(map(known.__getitem__, found))
        passing = {}
        for unit, value in zip(new, self.learn(new)):
            (known if len(unit) <= self.LONGEST else passing)[unit] = value
        if not passing:
            return list(map(known.__getitem__, found))
        return [passing[u] if u in passing else known[u] for u in found]


class WordMemory(dict):
    """The same for words that are learnt one at a time. A word that is here is looked up like in any dictionary."""

    LONGEST = UnitMemory.LONGEST
    KEPT = 349_000  # what a table of 2^19 places holds before it grows

    def __init__(self, learn):
        self.learn = learn
        self.older: dict = {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.learn(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def cut_at_blanks(path: str) -> bool:
    """Whether the tokenizer of a file is known to cut wherever ``units`` does, and nothing else to look over it."""
    found = json.loads(tokenizer(path).to_str())
    pre = found["pre_tokenizer"] or {}
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not found["normalizer"]
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in found["added_tokens"])
    )


class WordIds:
    """Ids of texts as the library gives them, which sees each word once.

    A byte-level tokenizer cuts a text into words and encodes each for itself. A new word goes to the
    library's model, in the letters that stand for its bytes; those met before are looked up.
    """

    def __init__(self, path: str):
        from stratalog.llm.bpe import byte_letters, word_finder

        self.library = tokenizer(path)
        self.model = self.library.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.words = word_finder(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = {t: array("I", [self.library.token_to_id(t)]).tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.blank = self.letters[ord(" ")]
        self.word = WordMemory(self._word)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # of these bytes only the blank has another letter
            letters = word.replace(" ", self.blank)
        else:
            letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        known = self.word.__getitem__
        pieces = self.cut.split(text) if self.cut else [text]
        if len(pieces) == 1 and text not in self.special:
            return b"".join(map(known, self.words(text)))
        parts = []
        for part in pieces:
            if part in self.special:
                parts.append(self.special[part])
            else:
                parts.extend(map(known, self.words(part)))
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
