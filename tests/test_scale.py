"""Ranges, bitmaps, versions and buckets: against brute force, and that the work is spread as promised."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import distincts, windows
from stratalog.plans import gold, jobs
from stratalog.registry import scale_queries
from stratalog.registry.base import GOLD_RULES, SILVER_RULES
from stratalog.sources import catalogue, readers, sinks, versions

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# ------------------------------------------------------------------------------ running totals


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows are in one partition; keys and values may be null."""
    rng = random.Random(3)
    data = []
    for i in range(4000):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        data.append((key, rng.randrange(40) or None, i, rng.choice([None, 1, 5, -2])))
    return data, spark.createDataFrame(data, "k string, day int, id int, v long").repartition(7)


def by_hand(data):
    found, totals = [], {}
    for k, day, i, v in sorted(data, key=lambda r: (r[0] or "", r[1] or 0, r[2])):
        if v is not None:
            totals[k] = (totals.get(k) or 0) + v
        found.append((k, day, i, v, totals.get(k)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 9, 64])
def test_running_total_in_ranges(hot, ranges):
    data, df = hot
    assert rows(windows.accumulate_in_ranges(df, ["k"], ["day", "id"], "v", "total", ranges)) == by_hand(data)


def test_running_total_equals_the_plain_one(hot):
    _, df = hot
    spread = windows.accumulate_in_ranges(df, ["k"], ["day", "id"], "v", "total")
    plain = windows.accumulate(df, ["k"], ["day", "id"], "v", "total")
    assert rows(spread) == rows(plain) and spread.dtypes == plain.dtypes


def test_a_hot_partition_is_cut_into_even_ranges(hot):
    data, df = hot
    sizes = [r[0] for r in windows.in_ranges(df, ["k", "day", "id"], "span", 16).groupBy("span").count().select("count").collect()]
    assert len(sizes) == 16 and sum(sizes) == len(data) and max(sizes) <= 2 * len(data) / 16


def test_leading_nulls_have_no_total(spark):
    df = spark.createDataFrame([("a", i, None if i < 50 else 1) for i in range(100)], "k string, id int, v int")
    found = windows.accumulate_in_ranges(df, ["k"], ["id"], "v", "t", 8).orderBy("id").collect()
    assert [r.t for r in found] == [None] * 50 + list(range(1, 51))


def test_decimals_columns_with_taken_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, 2, 10), (2, 3, 20)], "_range int, _before int, v int").withColumn(
        "v", F.col("v").cast("decimal(20,2)")
    )
    found = windows.accumulate_in_ranges(df, [], ["_range"], "v", "t", 4)
    assert found.columns == ["_range", "_before", "v", "t"] and dict(found.dtypes)["t"] == "decimal(30,2)"
    assert [int(r.t) for r in found.orderBy("_range").collect()] == [10, 30]
    assert windows.accumulate_in_ranges(df.where("v < 0"), [], ["_range"], "v", "t", 4).count() == 0


# ------------------------------------------------------------------------------ distinct counts


def test_dense_ids(spark):
    df = spark.range(100_000).select((F.col("id") % 40_001).cast("string").alias("c")).union(spark.sql("SELECT NULL"))
    found = distincts.dense_ids(df, "c", 8).collect()
    assert [r.value for r in sorted(found, key=lambda r: r.id)] == sorted(str(i) for i in range(40_001))
    assert sorted(r.id for r in found) == list(range(1, 40_002))


def test_counts_for_every_subset_of_keys_and_more_than_one_block(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice([1, 2, None]), rng.choice(["x", "y"]), rng.randrange(90_000), rng.choice([None, 1, 2])) for _ in range(60_000)]
    data.append(("c", 1, "x", None, None))
    df = spark.createDataFrame(data, "p string, q int, r string, wide int, small int")
    states = distincts.distinct_states(df, ["p", "q", "r"], {c: distincts.dense_ids(df, c) for c in ("wide", "small")})
    stored = states.persist()
    assert stored.agg(F.max("block")).first()[0] == 2
    for size in range(4):
        for keys in itertools.combinations(["p", "q", "r"], size):
            found = distincts.distinct_counts(stored, keys, ["wide", "small"])
            assert "Expand" not in plan_of(found)
            expected = df.groupBy(*keys).agg(F.count_distinct("wide").alias("wide"), F.count_distinct("small").alias("small"))
            assert rows(found) == rows(expected)
    part = distincts.distinct_counts(stored.where("q = 1 AND r = 'x'"), ["p"], ["small"])
    assert rows(part) == rows(df.where("q = 1 AND r = 'x'").groupBy("p").agg(F.count_distinct("small").alias("small")))
    stored.unpersist()


def test_states_of_parts_merge_and_unknown_values_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("a", 1)], "k string, c int")
    ids = {"c": distincts.dense_ids(df, "c")}
    parts = distincts.distinct_states(df.limit(2), ["k"], ids).union(distincts.distinct_states(df.exceptAll(df.limit(2)), ["k"], ids))
    assert rows(distincts.distinct_counts(distincts.merged_states(parts, ["k"]), ["k"], ["c"])) == [("a", 2), ("b", 1)]
    other = spark.createDataFrame([("a", 9)], "k string, c int")
    with pytest.raises(Exception, match="has no number"):
        distincts.distinct_states(other, ["k"], ids).collect()


def test_no_titles_have_no_sets(silver):
    assert gold.distinct_sets(silver.where("false")).count() == 0


# ------------------------------------------------------------------------------ safe overwrites


@pytest.fixture
def database(spark):
    name = "versions_test"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def broken(spark):
    """Writes most of its rows, then fails."""
    return spark.range(0, 1000, 1, 4).select(
        F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("id")
    )


def test_a_write_that_fails_half_way_leaves_the_old_table(spark, database, tmp_path):
    root = str(tmp_path)
    versions.publish(spark.range(5).toDF("id"), database, "t", root)
    reader = catalogue.read_table(spark, database, "t")
    with pytest.raises(Exception, match="killed"):
        versions.publish(broken(spark), database, "t", root)
    assert rows(reader) == rows(catalogue.read_table(spark, database, "t")) == [(i,) for i in range(5)]
    assert len(versions.versions(spark, root)) == 1


def test_a_reader_keeps_its_version_until_it_is_forgotten(spark, database, tmp_path):
    root = str(tmp_path)
    versions.publish(spark.range(5).toDF("id"), database, "t", root)
    reader = catalogue.read_table(spark, database, "t")
    # The new version has another column; its partition column comes last.
    versions.publish(spark.range(3).selectExpr("id % 2 AS p", "id", "'x' AS c"), database, "t", root, "p")
    assert rows(reader) == [(i,) for i in range(5)]
    assert catalogue.read_table(spark, database, "t").columns == ["id", "c", "p"]
    assert rows(catalogue.read_table(spark, database, "t").where("p = 1")) == [(1, "x", 1)]
    assert versions.forget(spark, root, keep=2) == []
    first, second = versions.versions(spark, root)
    assert versions.forget(spark, root, keep=0) == [first] and versions.versions(spark, root) == [second]
    assert catalogue.read_table(spark, database, "t").count() == 3
    assert versions.versions(spark, f"{root}/nothing") == []


def test_names_of_a_bundle_are_switched_together_or_not_at_all(spark, database, bronze, tmp_path):
    root = str(tmp_path)
    report = jobs.publish_all(spark, bronze.where("type = 'Movie'"), root, database, SILVER_RULES, GOLD_RULES).first()
    before = {n: rows(t) for n, t in catalogue.load_gold(spark, database).items()}
    assert catalogue.read_table(spark, database, "silver").count() == report.final_count
    with pytest.raises(Exception):
        bad = F.when(F.col("type") == "Movie", F.col("title")).otherwise(F.raise_error(F.lit("killed")))
        jobs.publish_all(spark, bronze.withColumn("title", bad), root, database, SILVER_RULES, GOLD_RULES)
    assert {n: rows(t) for n, t in catalogue.load_gold(spark, database).items()} == before
    assert len(versions.versions(spark, root)) == 1


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    kept = {f.name for f in (tmp_path / "t" / "p=a").iterdir()}
    sinks.overwrite_partitions(spark.createDataFrame([(3, "b"), (4, "c")], "v int, p string"), path, "p")
    assert rows(readers.read_parquet(spark, path)) == [(1, "a"), (3, "b"), (4, "c")]
    assert {f.name for f in (tmp_path / "t" / "p=a").iterdir()} == kept
    with pytest.raises(Exception, match="killed"):
        sinks.overwrite_partitions(broken(spark).withColumn("p", F.lit("a")), path, "p")
    assert rows(readers.read_parquet(spark, path)) == [(1, "a"), (3, "b"), (4, "c")]


# -------------------------------------------------------------------------- joins without a shuffle


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_buckets_join_group_and_dedupe_without_an_exchange(spark):
    joined = scale_queries._bucketed_lines(spark, SF)
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert exchanges(joined) == 0
    lines = scale_queries.store(spark, SF).bucketed("lineitem", "l_orderkey")
    first = windows.top_k(lines, ["l_orderkey"], [F.asc("l_linenumber")], 1, "rank")
    assert exchanges(first) == 0 and exchanges(lines.groupBy("l_orderkey").count()) == 0
    assert first.count() == lines.select("l_orderkey").distinct().count()
