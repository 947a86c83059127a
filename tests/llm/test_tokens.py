"""Token counts, ids and decoding against the library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import bpe, token_counts
from stratalog.llm.tokens import UnitMemory, safe_pieces, word_ids, units, vocabulary_path


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(vocabulary_path(None))


@pytest.mark.parametrize("table", ["hard", "small"])
def test_counts(table, library, request):
    df = request.getfixturevalue(table)
    expected = sorted(
        (
            (r.doc_id, len((r.text or "").encode()), n, n > 1024)
            for r in df.collect()
            for n in [len(ids_of(library, r.text))]
        ),
        key=repr,
    )
    assert sorted((tuple(r) for r in token_counts.with_token_counts(df).collect()), key=repr) == expected


@pytest.mark.parametrize("table", ["hard", "small"])
def test_digests(table, library, request):
    df = request.getfixturevalue(table)
    expected = []
    for r in df.collect():
        ids = ids_of(library, r.text)
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((
            r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        ))
    assert sorted((tuple(r) for r in bpe.encoding_digests(df).collect()), key=repr) == sorted(expected, key=repr)


def test_ids_and_decoded_texts(hard, library):
    for row in bpe.encoded(hard).join(hard.select("doc_id", "text"), "doc_id").collect():
        assert list(row.ids) == ids_of(library, row.text)
        assert row.decoded == (row.text or "")


def test_nothing(nothing):
    assert token_counts.with_token_counts(nothing).count() == 0
    assert bpe.encoding_digests(nothing).count() == 0 and bpe.encoded(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcst're  \n\t09.,!é漢😀 <|endoftext|>"), max_size=80) | st.text(max_size=40))
def test_encoder_equals_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _LIBRARY
    try:
        _LIBRARY
    except NameError:
        _LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.encoder(vocabulary_path(None))
    ids = ids_of(_LIBRARY, text)
    assert own.encode(text) == ids
    assert own.decode(ids) == _LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_both_ways_find_the_same_words(text):
    import re

    import regex

    assert re.findall(bpe.LATIN_WORDS, text) == regex.findall(bpe.WORDS, text)


def test_runs_of_one_letter(own, library):
    for text in ("a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 999, "é" * 777):
        assert own.encode(text) == ids_of(library, text)


def test_decoding_broken_bytes(own, library):
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(1, 9))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_safe_pieces_are_tokenised_alike(library):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t.'s1<|endoftext|>") for _ in range(rng.randrange(200)))
        pieces = safe_pieces(text, rng.randrange(1, 30))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in ids_of(library, p)] == ids_of(library, text)


def test_batches_are_even_and_long_texts_cut():
    seen = []

    def encode(pieces):
        seen.append([len(p) for p in pieces])
        return pieces  # a token for each character

    texts = ["ab " * 1000, None, "x", "cd ef " * 500]
    counts = token_counts.count_tokens(texts, encode, batch_bytes=500, piece_chars=100)
    assert counts.tolist() == [3000, 0, 1, 3000]
    assert max(map(sum, seen)) < 700 and max(map(max, seen)) < 110


def test_batches_hold_bytes_not_characters():
    seen = []

    def encode(pieces):
        seen.append(sum(len(p.encode()) for p in pieces))
        return pieces

    texts = ["漢字 " * 100, "😀" * 50, "a" * 300] * 20
    counts = token_counts.count_tokens(texts, encode, batch_bytes=1000, piece_chars=100)
    assert counts.tolist() == [300, 50, 300] * 20
    assert max(seen) < 1000 + 100 * 4


def test_every_character_is_cut_as_the_library_does(own, library):
    """All code points, each after and before a letter, itself, a number, a blank and a Chinese character.

    Ids are compared for all Latin ones and wherever another Unicode version would cut in another way.
    """
    import regex

    ids = word_ids(vocabulary_path(None))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    other = 0
    for start in range(0, len(points), 4096):
        # A line break between two letters keeps them apart.
        lines = ["a{0}{0}1 {0}\u6f22{0}z".format(chr(p)) for p in points[start : start + 4096]]
        text = "\n".join(lines)
        found = own.words(text)
        assert found == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        if points[start] <= 0x24F:
            doubtful = lines[:0x24F]
        elif found == regex.findall(bpe.WORDS, text):
            continue
        else:
            doubtful = [line for line in lines if own.words(line) != regex.findall(bpe.WORDS, line)]
            other += len(doubtful)
        for line in doubtful:
            expected = ids_of(library, line)
            assert own.encode(line) == expected
            assert memoryview(ids(line)).cast("I").tolist() == expected
    assert own.encode("\U00011db6\u6f22") == [172, 239, 114, 114, 162, 120, 95] and other > 1000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcst're  \n\t\x1c\xa0\u200309.,!é漢😀<|endoftext|>"), max_size=80) | st.text(max_size=40))
def test_words_and_units_make_up_the_text(text):
    ids = word_ids(vocabulary_path(None))
    assert "".join(ids.words(text)) == text
    first, *others = units(text)
    assert first + "".join(" " + u for u in others) == text
    assert memoryview(ids(text)).cast("I").tolist() == ids.library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded_by_bytes(own, library):
    """Two thousand words of 100 KB each are encoded and none is kept."""
    sizes = []
    memory = UnitMemory(lambda new: [len(u) for u in new])
    for k in range(2000):
        assert memory([f"{k:06}" + "x" * 100_000, "kept"]) == [100_006, 4]
        sizes.append(sum(map(len, memory.known)))
    assert max(sizes) == 4
    many = UnitMemory(lambda new: new)
    for k in range(0, 3 * UnitMemory.KEPT, 1000):
        many([f"w{i}" for i in range(k, k + 1000)])
    assert len(many.known) + len(many.older) <= 2 * (UnitMemory.KEPT + 1000)
    text = " ".join("ab" * 20_000 + str(k) for k in range(3))
    assert own.encode(text) == ids_of(library, text)
    assert not any(len(w) > UnitMemory.LONGEST for w in own.word.known)


def test_units_are_counted_once(library):
    """The library sees each unit once, not every text whole; counts are those of whole texts."""
    seen = []

    def encode(pieces):
        seen.extend(pieces)
        return library.encode_batch_fast(pieces, add_special_tokens=False)

    texts = ["", "one two  three\n four two", "<|endoftext|> two <|endoftext|>x two\u2003 y", " lead", "x" * 60 + " " + "y" * 60] * 50
    lengths = token_counts.UnitLengths(encode)
    expected = [len(ids_of(library, t)) for t in texts]
    assert lengths.count(texts, 1 << 20).tolist() == expected
    # Blank and unit once; first units, which have no blank before them, each time.
    assert len([p for p in seen if p == " two"]) == 1 and len(seen) < 2 * len(texts)
    assert lengths.count(texts, 1 << 20).tolist() == expected
    assert len([p for p in seen if p == " two"]) == 1
    assert not any(len(u) > lengths.LONGEST for u in lengths)


def test_generations_of_counts_are_bounded(library):
    lengths = token_counts.UnitLengths(lambda pieces: library.encode_batch_fast(pieces, add_special_tokens=False))
    lengths.KEPT = 100
    for k in range(0, 1000, 10):
        text = " ".join(f"w{i}" for i in range(k, k + 20))
        assert lengths.count([text], 1 << 20).tolist() == [len(ids_of(library, text))]
        assert len(lengths) + len(lengths.older) <= 2 * (100 + 20)


def test_units_need_a_tokenizer_that_cuts_at_blanks(tmp_path):
    import json

    from stratalog.llm.tokens import cut_at_blanks

    with open(vocabulary_path(None), encoding="utf-8") as file:
        model = json.load(file)
    assert cut_at_blanks(vocabulary_path(None))
    model["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "whole.json").write_text(json.dumps(model))
    assert not cut_at_blanks(str(tmp_path / "whole.json"))
    model["pre_tokenizer"]["use_regex"] = True
    model["added_tokens"][0]["rstrip"] = True
    (tmp_path / "strip.json").write_text(json.dumps(model))
    assert not cut_at_blanks(str(tmp_path / "strip.json"))


def test_words_are_learnt_once_and_bounded():
    from stratalog.llm.tokens import WordMemory

    learnt = []

    def learn(word):
        learnt.append(word)
        return word.encode()

    memory = WordMemory(learn)
    memory.KEPT = 10
    for word in [f"w{k}" for k in range(8)] * 5 + ["z" * 100, "z" * 100]:
        assert memory[word] == word.encode()
    assert len(learnt) == 10 and "z" * 100 not in memory
    for k in range(1000):
        assert memory[f"w{k % 37}"] == f"w{k % 37}".encode() and len(memory) + len(memory.older) <= 20


def test_words_are_looked_up_without_a_call():
    """Ids of a text are joined straight from the memory: met words take no function of this module."""
    import sys

    ids = word_ids(vocabulary_path(None))
    text = "the memory of words, met before " * 50
    first = ids(text)
    calls = []
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        again = ids(text)
    finally:
        sys.setprofile(None)
    assert again == first and len(calls) <= 4
