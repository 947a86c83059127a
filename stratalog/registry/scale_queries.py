"""Queries on detail too large for one task or one more shuffle: ranges, bitmaps, versions and buckets."""

from __future__ import annotations

import itertools
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.measures import steps, wide_sum
from stratalog.operators import distincts, windows
from stratalog.plans import gold as gold_plans
from stratalog.plans import jobs
from stratalog.registry.base import (
    GOLD_RULES,
    SILVER_RULES,
    bronze,
    register,
    silver,
    sql_on_bronze,
    sql_on_silver,
    store,
    table,
)
from stratalog.session import scratch_path
from stratalog.sources import catalogue, readers, sinks, versions

# ------------------------------------------------------------------------------ running totals


def _value_by_order(spark, sf_dir):
    """Three statuses hold all orders; the total runs over each order of them."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderdate", "o_orderkey", steps("o_totalprice", 2).cast("decimal(20,0)").alias("cents")
    )
    totals = windows.accumulate_in_ranges(
        orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "cents", "cents_so_far"
    )
    return totals.select("o_orderstatus", "o_orderkey", (F.col("cents_so_far").cast("double") / 100).alias("value_so_far"))


register(
    "f2_running_value_by_order",
    _value_by_order,
    """SELECT o_orderstatus, o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (
    PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 100
  AS value_so_far
FROM orders""",
)


def _titles_so_far(spark, sf_dir):
    """The number of a title among those of its type, of good quality, by the day they were added."""
    titles = silver(spark, sf_dir).where("data_quality_score >= 0.8").select(
        "content_type", "date_added", "show_id", F.lit(1).cast("long").alias("_one")
    )
    totals = windows.accumulate_in_ranges(titles, ["content_type"], ["date_added", "show_id"], "_one", "titles_so_far")
    return totals.drop("_one")


register(
    "f5_running_titles_after_filter",
    _titles_so_far,
    sql_on_silver(
        """SELECT content_type, date_added, show_id, count(*) OVER (PARTITION BY content_type
  ORDER BY date_added NULLS FIRST, show_id ROWS UNBOUNDED PRECEDING) AS titles_so_far
FROM silver WHERE data_quality_score >= 0.8"""
    ),
)

# ------------------------------------------------------------------------------ distinct counts
_KEYS, _COUNTED = gold_plans.DISTINCT_KEYS, gold_plans.DISTINCT_COLUMNS
_NAMES = {"primary_country": "countries", "primary_genre": "genres"}


def _every_subset(spark, sf_dir):
    """Counts for all eight subsets of the keys, from one table of sets."""
    sets = store(spark, sf_dir).distincts()
    types = dict(sets.dtypes)
    parts = []
    for size in range(len(_KEYS) + 1):
        for keys in itertools.combinations(_KEYS, size):
            counts = distincts.distinct_counts(sets, keys, _COUNTED)
            absent = {k: F.lit(None).cast(types[k]) for k in _KEYS if k not in keys}
            level = F.lit(" ".join(keys)).alias("level")
            parts.append(counts.withColumns(absent).select(level, *_KEYS, *_COUNTED))
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed(_NAMES)


register(
    "e5_distincts_of_every_key_subset",
    _every_subset,
    sql_on_silver(
        """SELECT concat_ws(' ', CASE WHEN grouping(content_type) = 0 THEN 'content_type' END,
    CASE WHEN grouping(rating) = 0 THEN 'rating' END,
    CASE WHEN grouping(added_year) = 0 THEN 'added_year' END) AS level,
  content_type, rating, added_year,
  count(DISTINCT primary_country) AS countries, count(DISTINCT primary_genre) AS genres
FROM silver GROUP BY CUBE (content_type, rating, added_year)"""
    ),
)


def _filtered_distincts(spark, sf_dir):
    sets = store(spark, sf_dir).distincts().where("added_year >= 2018 AND rating IN ('TV-MA', 'R')")
    return distincts.distinct_counts(sets, ["content_type"], _COUNTED).withColumnsRenamed(_NAMES)


register(
    "e6_filtered_distincts",
    _filtered_distincts,
    sql_on_silver(
        """SELECT content_type, count(DISTINCT primary_country) AS countries, count(DISTINCT primary_genre) AS genres
FROM silver WHERE added_year >= 2018 AND rating IN ('TV-MA', 'R') GROUP BY 1"""
    ),
)

# ------------------------------------------------------------------------------ safe overwrites


def _partitions_replaced(spark, sf_dir):
    """Silver of all titles; then the folder of one type is replaced, and the others stay."""
    path = scratch_path(spark, "silver")
    sinks.write_partitioned(silver(spark, sf_dir), path)
    movies = readers.read_parquet(spark, path).where("content_type = 'Movie' AND is_recent")
    staged = scratch_path(spark, "movies")
    sinks.write_parquet(movies, staged)
    sinks.overwrite_partitions(readers.read_parquet(spark, staged), path)
    return readers.read_parquet(spark, path).select("show_id", "content_type", "title")


register(
    "a4_partitions_replaced",
    _partitions_replaced,
    sql_on_silver("SELECT show_id, content_type, title FROM silver WHERE content_type <> 'Movie' OR is_recent"),
)


def _published_versions(spark, sf_dir):
    """Two versions under one name; readers have the second, and the first is forgotten."""
    database, root = store(spark, sf_dir).database, scratch_path(spark, "versions")
    name = f"orders_{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    versions.publish(orders.withColumn("o_orderpriority", F.lit("first")), database, name, root)
    versions.publish(orders, database, name, root)
    if len(versions.forget(spark, root, keep=1)) != 1:
        raise AssertionError("the first version stayed")
    return (
        catalogue.read_table(spark, database, name)
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    )


register(
    "a5_published_versions",
    _published_versions,
    """SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY 1""",
)


def _published_layers(spark, sf_dir):
    database, root = store(spark, sf_dir).database, scratch_path(spark, "layers")
    name = f"{database}_{uuid.uuid4().hex[:8]}"
    try:
        report = jobs.publish_all(spark, bronze(spark, sf_dir), root, name, SILVER_RULES, GOLD_RULES)
        titles = catalogue.query(spark, "SELECT count(*) AS n FROM silver", name).first().n
        counted = catalogue.load_gold(spark, name)["content_overview"].first().total_content_count
        if not titles == counted == report.first().final_count:
            raise AssertionError("the published layers disagree with the report")
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    return report.select("initial_count", "final_count", "rejected_count")


_VALID = "NOT (show_id IS NULL OR trim(show_id) = '') AND NOT (title IS NULL OR trim(title) = '')"
register(
    "m4_published_layers",
    _published_layers,
    sql_on_bronze(
        f"""SELECT count(*) AS initial_count, count(DISTINCT show_id) FILTER (WHERE {_VALID}) AS final_count,
  count(*) FILTER (WHERE NOT ({_VALID})) AS rejected_count
FROM bronze"""
    ),
)

# -------------------------------------------------------------------------- joins without a shuffle


def _bucketed_lines(spark, sf_dir):
    """Orders and their lines are in buckets of the order key: neither the join nor the sum shuffles."""
    stored = store(spark, sf_dir)
    orders, lines = stored.bucketed("orders", "o_orderkey"), stored.bucketed("lineitem", "l_orderkey")
    # Both sides are large in use; the hint keeps small test tables from a broadcast.
    joined = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(
        F.count(F.lit(1)).alias("lines"), (wide_sum(steps("l_extendedprice", 2)).cast("double") / 100).alias("price")
    )


register(
    "d1_bucketed_order_lines",
    _bucketed_lines,
    """SELECT o_orderkey, o_orderdate, count(*) AS lines,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
)
