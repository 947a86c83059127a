"""Filters ahead of joins, ranks without hot groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalog.llm import common


@pytest.fixture(scope="module")
def wide(spark):
    rows = spark.range(5000).selectExpr(
        "if(id % 10 = 0, NULL, id % 3000) AS k", "id AS _block", "'x' AS _bitmap", "id AS _hit", "id AS gone_id", "id AS _place"
    )
    return rows.repartition(4)


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(700).selectExpr("if(id = 5, NULL, id * 4) AS key").union(spark.sql("SELECT 8L"))


def test_members_pass(wide, keys):
    wanted = {r.key for r in keys.collect()}
    passed = common.members_first(wide, "k", keys)
    assert passed.columns == wide.columns
    got, every = Counter(map(tuple, passed.collect())), Counter(map(tuple, wide.collect()))
    assert not got - every and not Counter({r: n for r, n in every.items() if r[0] in wanted}) - got
    assert sum(got.values()) < 0.5 * 5000  # and few others


def test_without(wide, keys):
    left = common.without(wide, "k", keys)
    assert left.columns == wide.columns
    wanted = {r.key for r in keys.collect()} - {None}  # rows without a key stay
    assert Counter(map(tuple, left.collect())) == Counter(tuple(r) for r in wide.collect() if r.k not in wanted)
    assert common.without(wide, "k", keys.where("key < 0")).count() == 5000


def test_ranks(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', 'g' || id % 50) AS g", "int(hash(id) % 7) + 7 AS b", "id")
    out = common.ranked(df.repartition(5), ["g"], "b", [F.col("id")], "rank").collect()
    for group in {r.g for r in out}:
        members = sorted((r for r in out if r.g == group), key=lambda r: (r.b, r.id))
        assert [r["rank"] for r in members] == list(range(len(members)))


def test_batches_for_workers_are_bounded_by_bytes(spark):
    """Texts of 100 KB come in batches of a few MB, unless the session says otherwise."""
    import pyarrow as pa

    from stratalog.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    texts = spark.range(300, numPartitions=1).selectExpr("id", "repeat('x', 100000) AS text")
    before = spark.conf.get(common.BATCH_SETTING)
    try:
        spark.conf.set(common.BATCH_SETTING, common.BATCH_UNSET)
        common.ship(spark)
        found = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
        assert sum(found) == 300 and max(found) * 100_000 < 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_SETTING, 16 << 20)
        common.ship(spark)
        assert max(r.n for r in texts.mapInArrow(sizes, "n bigint").collect()) > 100
    finally:
        spark.conf.set(common.BATCH_SETTING, before)


def test_workers_give_memory_back():
    import os

    import numpy as np

    from stratalog.llm.common import give_back

    def held():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    before = held()
    parts = [np.ones(5000) for _ in range(2000)]  # 80 MB in small pieces, with a last one above them
    last = np.ones(5000)
    del parts
    give_back()
    assert held() - before < 20 << 20 and len(last) == 5000
