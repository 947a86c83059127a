"""The shape of the physical plans: what they read, what they shuffle, what they avoid."""

import re

import pytest

from conftest import SF_DIR
from pyspark.sql import functions as F

from stratalog.operators import aggregates
from stratalog.plans import gold
from stratalog.registry import entries
from stratalog.sources import readers, sinks

CHECKED = [
    n for n in entries() if re.match(r"k|d|f|h|e1[1-9]|e20|c02|c22|c23|l1[1347]|l28|l4[26]", n)
]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_no_python_no_hint(spark, name):
    df = entries()[name].run(spark, SF_DIR)
    plan = physical(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
                "MapInPandas", "BatchEvalPython"):
        assert bad not in plan
    assert "hint" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.fixture(scope="module")
def written(spark, silver, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("silver") / "t")
    sinks.write_partitioned(silver, path)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    # Plans print the columns and filters of a scan in full.
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield readers.read_parquet(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", before)


READS = {
    "content_overview": ["show_id", "description", "title", "rating"],
    "genre_analysis": ["show_id", "description", "title", "rating", "country"],
    "geographic_distribution": ["show_id", "description", "title", "rating", "genre"],
    "temporal_trends": ["show_id", "description", "title", "rating", "genre", "director"],
    "rating_distribution": ["show_id", "description", "title", "genre", "director"],
    "top_producers": ["show_id", "description", "title", "rating", "duration"],
}


@pytest.mark.parametrize("name", READS)
def test_gold_reads_only_what_it_needs(written, name):
    plan = physical(gold.build(name, written))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    # One scan, however many measures.
    assert len(schemas) == 1
    read = {c.split(":")[0] for c in schemas[0].split(",")}
    assert not read & set(READS[name])


PUSHED = {
    "genre_analysis": ["Not(EqualTo(primary_genre,Uncategorized))"],
    "geographic_distribution": ["Not(EqualTo(primary_country,Unknown))"],
    "temporal_trends": ["IsNotNull(date_added)"],
    "top_producers": ["Not(EqualTo(director,Unknown))", "Not(StringContains(director,,))"],
}


@pytest.mark.parametrize("name", PUSHED)
def test_gold_filters_reach_the_scan(written, name):
    plan = physical(gold.build(name, written))
    filters = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert all(f in filters for f in PUSHED[name])


def test_overview_counts_distinct_over_groups_only(written):
    plan = physical(gold.content_overview(written))
    expand, scan = plan.index("Expand"), plan.index("FileScan")
    # Between the scan and the repeating Expand lies the aggregation by country and genre.
    assert "hashpartitioning(primary_country" in plan[expand:scan]


def test_sample_titles_and_ranks_are_limited_before_the_shuffle(written):
    for df in (gold.sample_titles(gold.with_quality_tier(written)), gold.top_producers(written)):
        plan = physical(df)
        assert plan.count("WindowGroupLimit") == 2


def test_top_n_is_not_a_full_sort(spark):
    plan = physical(entries()["g4_top_orders"].run(spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_sets_are_built_of_ranked_directors_only(written):
    plan = physical(gold.build("top_producers", written))
    before, _, after = plan.partition("dense_rank")
    assert "ObjectHashAggregate" in before  # the plan is printed from its end
    assert "ObjectHashAggregate" not in after


def test_conditional_distinct_does_not_repeat_rows(written):
    counted = aggregates.distinct_where(
        written, ["rating"], "show_id", {"a": F.col("has_cast"), "b": F.col("has_director")}
    )
    assert "Expand" not in physical(counted)


def test_rejects_are_a_filter(bronze):
    plan = physical(entries()["h1_difference"].run(bronze.sparkSession, SF_DIR))
    assert "LeftAnti" not in plan


def test_total_order_reads_only_columns_in_use(spark):
    plan = physical(entries()["c02_latest_event_per_user"].run(spark, SF_DIR))
    assert "props" not in plan and "value" not in plan
