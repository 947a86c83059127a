"""Centroids against a plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import centroids as op

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance string, _cluster int"


def by_hand(rows, dimensions, clusters, rounds):
    kept = []
    for doc, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((doc, tuple(math.floor(256 * x) for x in vector)))
    order = sorted(
        kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    )
    centres = [list(v) for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centres)]
    found = [(doc, *nearest(v)[::-1]) for doc, v in kept]
    total = sum(d for _, _, d in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(doc, k, d, sum(e for _, j, e in found if j == k), total, digest[k]) for doc, k, d in found]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)


def found(df, **options):
    return sorted((tuple(r) for r in op.with_inertia(*op.clustered(df, **options)).collect()), key=repr)


def vectors(n, dimensions, seed):
    rng = random.Random(seed)
    return [(k, [float(np.float32(rng.gauss(k % 5, 0.7))) for _ in range(dimensions)]) for k in range(n)]


@pytest.mark.parametrize("block", [1, 3, 8])
def test_rounds(spark, block):
    rows = vectors(150, 8, 1)
    rows += [(k, rows[3][1]) for k in range(200, 260)]  # a hot vector
    rows += [(4, rows[9][1]), (4, rows[9][1]), (None, rows[5][1]), (None, [0.0] * 8)]
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7)]
    expected = by_hand(rows, 8, 7, 4)
    assert found(frame(spark, rows), dimensions=8, clusters=7, rounds=4, block=block) == sorted(expected, key=repr)


def test_empty_clusters_stay(spark):
    rows = [(k, [1.0, 2.0]) for k in range(5)] + [(k, [float(k), 0.0]) for k in range(10, 13)]
    assert found(frame(spark, rows), dimensions=2, clusters=6, rounds=3) == sorted(by_hand(rows, 2, 6, 3), key=repr)


def test_few_and_none(spark):
    rows = vectors(3, 4, 2)
    assert found(frame(spark, rows), dimensions=4, clusters=9, rounds=2) == sorted(by_hand(rows, 4, 9, 2), key=repr)
    assert found(frame(spark, []), dimensions=4) == []


def test_too_large_a_component_fails(spark):
    with pytest.raises(Exception, match="beyond"):
        found(frame(spark, [(1, [1e30, 0.0])]), dimensions=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 7), st.integers(1, 7), st.integers(0, 2**32))
def test_distances_by_dictionaries(n, dimensions, block, seed):
    rng = np.random.default_rng(seed)
    whole = rng.integers(-4, 4, (n, dimensions))
    centres = rng.integers(-op.LARGEST, op.LARGEST, (3, dimensions))
    codes, entries = op.encode_blocks(whole, block)
    expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centres] for v in whole]
    assert op.distances(codes, entries, centres).tolist() == expected
