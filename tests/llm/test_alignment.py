"""Alignment against whole texts: both libraries on the text as it is, and all pairs of ranges."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import alignment as op


@pytest.fixture(scope="module")
def own():
    return op.Aligner(op._path(op.TOKENS_A), op._path(op.TOKENS_B))


def plain(own, text):
    """Tokens of the whole text with byte ranges, all overlapping pairs, groups at common ends."""
    if not text:
        return None
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    letters = {v: k for k, v in op.byte_letters().items()}
    assert all("".join(letters[x] for x in own.bytes_a[i]) == own.a.id_to_token(i) for i in a)
    pieces = []
    for i in b:
        piece = own.b.id_to_piece(i)
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        pieces.append(bytes([int(byte[1], 16)]) if byte and 3 <= i <= 258 else piece.replace("▁", " ").encode())
    data = (" " + text).encode()
    if b"".join(own.bytes_a[i] for i in a) != data or b"".join(pieces) != data:
        return None
    ends_a = np.cumsum([len(own.bytes_a[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(p) for p in pieces]).tolist()
    ranges_a, ranges_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))
    links = [(x, y) for x, (s, e) in zip(a, ranges_a) for y, (t, f) in zip(b, ranges_b) if s < f and t < e]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        m, n = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(f"{','.join(map(str, a[i:m]))}|{','.join(map(str, b[j:n]))}")
        i, j = m, n
    return a, b, links, groups


def by_hand(own, rows):
    each = [(doc, plain(own, text)) for doc, text in rows]
    counts = Counter(link for _, p in each if p for link in p[2])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc, p in each:
        if p is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = p
        out.append((
            doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in op.aligned(df, **options).collect()), key=repr)


@pytest.mark.parametrize("most_pairs", [op.MOST_PAIRS, 0])
def test_hard_rows(spark, hard, own, most_pairs):
    rows = [(r.doc_id, r.text if r.text is None else r.text[:3000]) for r in hard.collect()]
    rows += [(50, "<s> </s> <unk> <0x41> <|endoftext|>"), (51, "▁"), (52, "a▁b"), (53, "日本語テキスト と 𓀀𓀁 🤷🏽‍♀️"), (54, "  two  blanks \n\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(df, most_pairs=most_pairs) == by_hand(own, rows)


def test_documents(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 1500]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(df) == by_hand(own, rows)
    texts = {r.doc_id: r.groups for r in op.spans(df).collect()}
    for doc, text in rows[:40]:
        p = plain(own, text)
        assert texts[doc] == (None if p is None else ";".join(p[3]))


def test_long_texts_without_blanks(spark, own):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("漢字かなabcé😀") for _ in range(1200))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == by_hand(own, rows)


def test_nothing(nothing):
    assert found(nothing) == []


@settings(max_examples=250, deadline=None)
@given(st.text(alphabet=st.sampled_from("abct're  \n\t  09.,!é漢😀𓀀▁<s>0x4"), max_size=50) | st.text(max_size=30))
def test_units_are_aligned_as_the_text(text):
    global _OWN
    try:
        _OWN
    except NameError:
        _OWN = op.Aligner(op._path(op.TOKENS_A), op._path(op.TOKENS_B))
    expected, units = plain(_OWN, text), _OWN.text(text)
    assert (expected is None) == (units is None)
    if expected is not None:
        assert ";".join(groups for _, _, groups in units) == ";".join(expected[3])
        links = Counter()
        for _, pairs, _ in units:
            for pair in np.frombuffer(pairs, np.int64).tolist():
                links[pair >> 32, pair & 0xFFFFFFFF] += 1
        assert links == Counter(expected[2])


def test_coarse_cuts_are_refined():
    # One character of three bytes over three tokens, between whole ones.
    assert op.refined_ends(np.array([2, 5, 5, 5, 6]), np.array([0, 2, 2, 2, 5]), np.array([2, 1, 1, 1, 1])).tolist() == [2, 3, 4, 5, 6]
    # A fallback span that is told by its last byte only.
    assert op.refined_ends(np.array([2, 2, 2, 5]), np.array([0, 2, 2, 2]), np.array([2, 1, 1, 1])).tolist() == [2, 3, 4, 5]


def test_new_units_of_several_texts_are_aligned_at_once(own, monkeypatch):
    """A call of both libraries for many texts; a unit that cannot be aligned costs a few more, not one for each."""
    texts = [" ".join(f"new{i}x{k}" for k in range(30)) for i in range(40)]
    fresh, alone = op.Aligner(op._path(op.TOKENS_A), op._path(op.TOKENS_B)), []
    aligned = fresh._aligned
    monkeypatch.setattr(fresh, "_aligned", lambda found: alone.append(len(found)) or aligned(found))
    assert fresh.texts([None, "", *texts]) == [None, None, *map(own.text, texts)]
    assert len(alone) == 1
    alone.clear()
    monkeypatch.setattr(fresh, "_aligned", lambda found: alone.append(len(found)) or (None if "bad" in found else aligned(found)))
    mixed = [*texts[:20], "one bad other", *(f"more{i} units{i}" for i in range(300))]
    found = fresh.texts(mixed)
    assert found[20] is None and [f for f in found if f] == [own.text(t) for t in mixed if "bad" not in t]
    assert len(alone) < 40
