"""Fingerprints against a plain implementation, edits against a plain loop, the search against all pairs."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash

from stratalog.llm import simhash as op

MASK = 2**64 - 1


def term_hash(first, *values):
    seed = first
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v, seed=seed)
    return seed


def fingerprint(text):
    words = re.split(r"[\x20\x09-\x0D]+", text)
    votes, total = Counter(), 0
    for i, word in enumerate(words):
        following = words[i + 1].encode() if i + 1 < len(words) else None
        weight = min(len(word) + (len(words[i + 1]) if following is not None else 0), 16)
        high = term_hash(42, word.encode(), following)
        low = term_hash(42, (1).to_bytes(4, "little"), following, word.encode())
        total += weight
        for bit in range(64):
            votes[bit + 64] += weight * (high >> bit & 1)
            votes[bit] += weight * (low >> bit & 1)
    return sum(1 << b for b in range(128) if 2 * votes[b] > total)


def by_hand(rows, radius, every):
    rows = sorted({(d, t or "") for d, t in rows if d is not None})
    ids = sorted({d for d, _ in rows})
    first_text = {d: min(t for e, t in rows if e == d) for d in ids}
    prints = {r: fingerprint(r[1]) for r in rows}
    out = []
    for d, t in rows:
        following = ids[ids.index(d) - 1]
        third = len(t) // 3
        new = t[: len(t) - third] + first_text[following][:third]
        own, other = prints[(d, t)], fingerprint(new)
        near_next = 1 - (own ^ prints[(following, first_text[following])]).bit_count() / 128
        n_near = sum((own ^ p).bit_count() <= radius for p in prints.values()) if d % every == 0 else None
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{own:032x}", f"{other:032x}",
                    1 - (own ^ other).bit_count() / 128, near_next, n_near))
    return sorted(out)


@pytest.mark.parametrize("table", ["hard", "small"])
def test_fingerprints_and_edits(table, request):
    df = request.getfixturevalue(table)
    out = sorted(tuple(r) for r in op.edited_fingerprints(df, every=3).collect())
    expected = by_hand([(r.doc_id, r.text) for r in df.collect()], op.RADIUS, 3)
    assert [r[:-2] + r[-1:] for r in out] == [r[:-2] + r[-1:] for r in expected]
    if table == "small":
        assert out == expected


def test_nothing(nothing):
    assert op.edited_fingerprints(nothing).count() == 0


def test_a_single_document_follows_itself(spark):
    df = spark.createDataFrame([(5, "abc def ghi")], "doc_id bigint, text string")
    row = op.edited_fingerprints(df).collect()[0]
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


def test_texts_of_different_ids_with_gaps(spark):
    rows = [(10**k, f"text number {k} with some words {k}{k}") for k in range(16)] + [(-(10**9), "negative one here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(tuple(r) for r in op.edited_fingerprints(df).collect()) == by_hand(rows, op.RADIUS, 50)


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_search(spark, radius):
    import random

    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for p in list(prints):
        for flips in range(8):
            q = p
            for bit in rng.sample(range(128), flips):
                q ^= 1 << bit
            prints.append(q)
    df = spark.createDataFrame([(signed(p >> 64), signed(p & MASK)) for p in prints], "high bigint, low bigint")
    asked = prints[:60]
    queries = spark.createDataFrame([(signed(p >> 64), signed(p & MASK)) for p in asked], "high bigint, low bigint")
    out = Counter(
        ((r.query_high & MASK) << 64 | r.query_low & MASK, (r.high & MASK) << 64 | r.low & MASK, r.distance)
        for r in op.within_radius(queries, df, radius).collect()
    )
    expected = {
        (a, b, (a ^ b).bit_count()) for a in set(asked) for b in set(prints) if (a ^ b).bit_count() <= radius
    }
    assert out == Counter(expected)


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        op.within_radius(spark.range(1), spark.range(1), 128)


def test_no_python_in_the_plan(small):
    plan = op.edited_fingerprints(small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
