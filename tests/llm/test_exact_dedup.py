"""Exact copies against a plain grouping; the filters against counters."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import exact_dedup as op


def by_hand(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, text or ""))
    out = []
    for plain, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(plain.encode()).hexdigest()
        out += [(doc, keep, len(members), doc == keep, digest) for doc, _ in members]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in op.exact_groups(df).collect()), key=repr)


def test_hard_rows(hard):
    assert found(hard) == by_hand([(r.doc_id, r.text) for r in hard.collect()])


def test_small_table(small):
    assert found(small) == by_hand([(r.doc_id, r.text) for r in small.collect()])


def test_nothing(nothing):
    assert found(nothing) == []
    assert op.drop_copies(nothing).count() == 0


def test_one_row_of_each_group_stays_with_all_columns(hard):
    kept = op.drop_copies(hard)
    assert kept.columns == hard.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [3, 4, 5, 6, 7, 8, 8, 9, 11, 12, 13, 14, 15, 16, 17]  # row 8 is there twice


def test_group_size_of_a_hot_text(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot  text', 'text ' || id) AS text")
    sizes = op.exact_groups(df.repartition(7)).groupBy("group_size").count().collect()
    assert {r["group_size"]: r["count"] for r in sizes} == {1000: 1000, 1: 2000}


prints = st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50) | st.integers(2**63, 2**63 + 40), min_size=1)


@settings(max_examples=60, deadline=None)
@given(prints, prints, st.integers(0, 12))
def test_filters_merge_without_loss(a, b, block_bits):
    def build(values):
        numbers = np.array(sorted(values), dtype=np.uint64)
        merged, counts = op.merge_sorted(numbers, np.ones(len(numbers), np.uint64))
        blocks = merged >> np.uint64(64 - block_bits) if block_bits else merged * np.uint64(0)
        return [op.encode_filter(merged[blocks == x], counts[blocks == x], block_bits) for x in np.unique(blocks)]

    parts = [op.decode_filter(row, block_bits) for row in build(a) + build(b)]
    merged, counts = op.merge_sorted(*(np.concatenate(x) for x in zip(*parts)))
    assert dict(zip(merged.tolist(), counts.tolist())) == Counter(a + b)


def test_repeated_fingerprints(spark):
    df = spark.range(5000).selectExpr("xxhash64(id % 3001) AS f").repartition(5)
    out = {r.fingerprint: r.copies for r in op.repeated_fingerprints(df).collect()}
    assert len(out) == 1999 and set(out.values()) == {2}


def test_least_and_largest_ids(spark):
    ids = [-(2**63), 2**63 - 1, -(2**63) + 1, 0]
    df = spark.createDataFrame([(i, "same text") for i in ids] + [(None, "same  text")], "doc_id long, text string")
    assert {(r.keep_id, r.group_size) for r in op.exact_groups(df.where("doc_id IS NOT NULL")).collect()} == {(-(2**63), 4)}
    kept = [r.keep_id for r in op.exact_groups(df).collect()]
    assert kept == [None] * 5  # its original text is longer
