"""Packing: every piece once, no gaps, few sequences."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import packing as op


def check(df, library, capacity=op.CAPACITY):
    pieces = op.packed(df, capacity).collect()
    expected = Counter()
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            expected[(r.doc_id, number, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == expected
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for members in sequences.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(p.length for p in pieces)


@pytest.mark.parametrize("table", ["hard", "small"])
def test_pieces_and_places(table, library, request):
    df = request.getfixturevalue(table)
    count, tokens = check(df, library)
    assert count <= math.ceil(tokens / op.CAPACITY) + 1  # a bound that no packing can beat by more


def test_other_capacity(hard, library):
    check(hard, library, capacity=7)


def test_nothing(nothing):
    assert op.packed(nothing).count() == 0


def test_ids_of_pieces(hard, library):
    rows = op.tokenised_pieces(hard, with_ids=True).where("doc_id = 14").collect()
    assert rows[0].ids == library.encode("<|endoftext|> said I'm <|endoftext|>", add_special_tokens=False).ids + [0]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=6), st.integers(20, 30))
def test_placements_cover_the_histogram(histogram, capacity):
    ranks, filled = defaultdict(list), defaultdict(dict)
    for length, first, end, each, sequence, offset in op.placements(histogram, capacity):
        ranks[length] += range(first, end)
        for r in range(first, end):
            place = offset + (r - first) % each * length
            filled[sequence + (r - first) // each][place] = length
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for members in filled.values():
        end = 0
        for place, length in sorted(members.items()):
            assert place == end
            end += length
        assert end <= capacity


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(12, 25))
def test_a_bin_is_the_fullest_there_is(histogram, capacity):
    from itertools import product

    seed = max(histogram)
    chosen = Counter(op.fullest(histogram, capacity, seed))
    assert chosen[seed] and all(n <= histogram[k] for k, n in chosen.items())
    lengths = list(histogram)
    sums = [
        sum(k * n for k, n in zip(lengths, counts))
        for counts in product(*(range(histogram[k] + 1) for k in lengths))
        if counts[lengths.index(seed)]
    ]
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)
