"""Registered queries against their SQL on the smallest tables."""

import duckdb  # noqa: F401 - the comparison needs it
import pytest

from compare import compare, connect
from conftest import SF_DIR
from stratalog.registry import entries

# One of each kind; tools/compare.py runs them all.
SAMPLE = [
    "a1_csv_explicit_schema", "a8_csv_export", "b01_rename", "c01_rejected_rows", "c23_strict_profile",
    "d2_left_join_samples", "d3_items_of_top_suppliers", "e20_region_nation_rollup",
    "f1_type_share_in_brand", "h1_difference", "h1_difference_all", "i1_text_functions",
    "k1_content_overview", "k2_genre_analysis", "k3_geographic_distribution",
    "k4_temporal_trends", "k5_rating_distribution", "k6_quality_scorecard", "k7_top_producers",
    "l05_summary_table", "l17_additions_by_year", "l28_temporal_kpis", "l42_field_matrix",
    "m1_silver_job",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_result_as_sql(spark, con, name):
    outcome = compare(spark, con, entries()[name], SF_DIR)
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


def test_every_query_has_sql():
    assert all(item.sql for item in entries().values())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entries()) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
