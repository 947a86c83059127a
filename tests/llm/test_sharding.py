"""Shards: even counts, gapless slots, the mixture of the whole in each."""

import zlib
from collections import Counter

import pytest

from stratalog.llm import sharding as op


def check(df, shards):
    rows = op.interleaved(df, shards).collect()
    expected = Counter(
        (r.doc_id, r.source, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect()
    )
    assert Counter((r.doc_id, r.source, r["size"], r.text_crc32) for r in rows) == expected
    assert all(r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    counts = Counter(r.shard for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for shard in range(shards):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
@pytest.mark.parametrize("table", ["hard", "small"])
def test_counts_and_slots(table, shards, request):
    check(request.getfixturevalue(table), shards)


def test_nothing(nothing):
    assert op.interleaved(nothing).count() == 0


def test_mixture_with_a_hot_source_and_many_tiny_ones(spark):
    df = spark.range(6000).selectExpr(
        "id AS doc_id",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'warm' || id % 5 ELSE 'own' || id END AS source",
        "repeat('x', int(id % 7)) AS text",
    )
    rows = check(df.repartition(5), 20)
    for shard in range(20):
        own = Counter(r.source if r.source.startswith(("hot", "warm")) else "own" for r in rows if r.shard == shard)
        assert 95 <= own["hot"] <= 105 and 75 <= own["own"] <= 125
        assert all(17 <= own[f"warm{k}"] <= 23 for k in range(5))


def test_does_not_depend_on_partitions(spark, small):
    def places(n):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted((r.doc_id, r.shard, r.slot) for r in op.interleaved(small.repartition(n)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert places(3) == places(11)


def test_seed_changes_the_order(small):
    a = {r.doc_id: r.slot for r in op.interleaved(small, seed=1).collect()}
    assert a != {r.doc_id: r.slot for r in op.interleaved(small, seed=2).collect()}
