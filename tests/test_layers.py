"""Silver and gold: schemas, invariants, edge inputs, and independence of the partitioning."""

import datetime

import pytest
from pyspark.sql import functions as F

from stratalog.config import GoldRules, SilverRules, StrictRules
from stratalog.plans import gold
from stratalog.plans.silver import rejected, silver as build_silver, strict_silver
from stratalog.schema import BRONZE_SCHEMA, GOLD_COLUMNS, SILVER_COLUMNS

RULES = GoldRules(report_date="2026-02-09", genre_min_titles=5, country_min_titles=5)
FIXED = SilverRules(processed_at="2026-02-09 12:00:00")


def rows(df):
    return sorted(repr(r) for r in df.collect())


@pytest.fixture(scope="module")
def tables(silver):
    return {name: gold.build(name, silver, RULES).persist() for name in gold.GOLD_TABLES}


def one_title(spark, **values):
    base = dict.fromkeys(BRONZE_SCHEMA.names) | {"show_id": "s1", "title": "T", "type": "Movie"}
    nullable = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in BRONZE_SCHEMA)
    return spark.createDataFrame([tuple((base | values).values())], nullable)


def test_columns(silver, bronze, tables):
    assert silver.columns == SILVER_COLUMNS
    assert rejected(bronze).columns == BRONZE_SCHEMA.names + ["rejection_reason", "rejected_at"]
    for name, df in tables.items():
        assert df.columns == GOLD_COLUMNS[name]


def test_gold_types(tables):
    kinds = dict(tables["content_overview"].dtypes)
    assert (kinds["report_date"], kinds["total_movies"], kinds["newest_release_year"]) == (
        "date", "bigint", "int",
    )
    assert dict(tables["quality_scorecard"].dtypes)["sample_titles"] == "array<string>"
    kinds = dict(tables["top_producers"].dtypes)
    assert (kinds["genres_worked_in"], kinds["rank_by_volume"], kinds["years_active"]) == (
        "array<string>", "int", "int",
    )


def test_silver_of_a_bare_title(spark):
    row = build_silver(one_title(spark)).first()
    assert (row.director, row.cast_and_crew, row.country) == ("Unknown", "Not Available", "Unknown")
    assert (row.rating, row.genre) == ("UNRATED", "Uncategorized")
    assert row.description == "No description available"
    assert (row.primary_genre, row.primary_country) == ("Uncategorized", "Unknown")
    assert (row.has_director, row.has_cast, row.is_recent) == (False, False, False)
    assert (row.duration_unit, row.duration_value, row.data_quality_score) == ("unknown", None, 0.0)
    assert row.content_age_years is None and row.processed_timestamp is not None


def test_silver_of_a_full_title(spark):
    df = one_title(
        spark, director=" D ", cast="C", country="A, B", date_added=" May 05, 2020",
        release_year=2021, rating=" tv-ma ", duration="2 Seasons", listed_in="G1 ,G2", type=" TV Show ",
    )
    row = build_silver(df).first()
    assert (row.content_type, row.director, row.rating) == ("TV Show", "D", "TV-MA")
    assert (row.date_added, row.added_year, row.added_month) == (datetime.date(2020, 5, 5), 2020, 5)
    assert (row.duration_value, row.duration_unit) == (2, "seasons")
    assert (row.primary_genre, row.primary_country) == ("G1", "A")
    assert (row.content_age_years, row.is_recent, row.data_quality_score) == (5, True, 1.0)
    older = build_silver(df, SilverRules(as_of_year=2027)).first()
    assert (older.content_age_years, older.is_recent) == (6, False)


def test_strict_silver(spark):
    row = strict_silver(one_title(spark, rating="66 min", director="", country="  ")).first()
    assert (row.rating, row.director, row.country) == ("UR", "Unknown", "  ")
    assert (row.date_added, row.release_year) == (datetime.date(1900, 1, 1), 0)
    assert (row.duration_value, row.duration_unit) == (0, "unknown")
    assert row.description_length == len("No Description Available")
    assert strict_silver(one_title(spark, title=None)).count() == 0
    assert strict_silver(one_title(spark, show_id=None)).count() == 0
    # Blank is not missing in this profile.
    assert strict_silver(one_title(spark, show_id=" ")).count() == 1


def test_strict_order_of_dedupe_and_drop(spark):
    df = one_title(spark, title=None).union(one_title(spark, title="T"))
    first_lacks_title = strict_silver(df, StrictRules(dedupe_order=("title",)))
    assert first_lacks_title.count() == 0


def test_rejects_and_silver_account_for_the_input(bronze, silver):
    valid = bronze.count() - rejected(bronze).count()
    assert valid > silver.count() == silver.select("show_id").distinct().count()


def test_distinct_rejects(bronze):
    all_rejects = rejected(bronze, FIXED)
    one_each = rejected(bronze, SilverRules(processed_at=FIXED.processed_at, distinct_rejects=True))
    assert one_each.count() == all_rejects.distinct().count() <= all_rejects.count()


def test_counts_agree_across_tables(silver, tables):
    overview = tables["content_overview"].first()
    total = overview.total_content_count
    assert total == silver.count() == overview.total_movies + overview.total_tv_shows
    for name in ("quality_scorecard", "rating_distribution"):
        assert tables[name].agg(F.sum("content_count")).first()[0] == total
    assert (
        tables["rating_distribution"].agg(F.sum("recent_content_count")).first()[0]
        == overview.recent_content_count
    )
    tiers = tables["quality_scorecard"]
    high = tiers.filter(F.col("quality_tier").rlike("Excellent|Good")).agg(F.sum("content_count"))
    assert high.first()[0] == overview.high_quality_content_count
    added = tables["temporal_trends"].agg(F.sum("content_added_count")).first()[0]
    assert added == tiers.agg(F.sum("has_date_added_count")).first()[0]


def test_cumulative_counts(tables):
    trends = tables["temporal_trends"].orderBy("content_type", "added_year", "added_month").collect()
    total = {}
    for r in trends:
        total[r.content_type] = total.get(r.content_type, 0) + r.content_added_count
        assert r.cumulative_content_count == total[r.content_type]


def test_shares_add_up(tables):
    for name, key, share in (
        ("genre_analysis", "content_type", "percentage_of_type"),
        ("rating_distribution", "content_type", "percentage_of_type"),
        ("quality_scorecard", "content_type", "percentage_of_type"),
        ("geographic_distribution", "primary_country", "percentage_of_country"),
    ):
        for r in tables[name].groupBy(key).agg(F.sum(share), F.count("*")).collect():
            assert abs(r[1] - 100) <= 0.005 * r[2] + 1e-9


def test_minimum_group_sizes(tables):
    assert tables["genre_analysis"].agg(F.min("content_count")).first()[0] >= 5
    assert tables["geographic_distribution"].agg(F.min("content_count")).first()[0] >= 5
    assert tables["top_producers"].agg(F.min("content_count")).first()[0] >= 2


def test_producer_ranks(tables):
    found = tables["top_producers"].collect()
    assert not any("," in r.director or r.director == "Unknown" for r in found)
    for kind in {r.content_type for r in found}:
        ranked = sorted((r for r in found if r.content_type == kind), key=lambda r: r.rank_by_volume)
        assert [r.rank_by_volume for r in ranked] == list(range(1, len(ranked) + 1))
        keys = [(-r.content_count, -r.avg_quality_score, r.director) for r in ranked]
        assert keys == sorted(keys)
    assert all(r.genres_worked_in == sorted(set(r.genres_worked_in)) for r in found)


def test_sample_titles(silver, tables):
    tiered = gold.with_quality_tier(silver, RULES).collect()
    for r in tables["quality_scorecard"].collect():
        titles = [
            (t.title, t.show_id)
            for t in tiered
            if (t.content_type, t.quality_tier) == (r.content_type, r.quality_tier)
        ]
        assert r.sample_titles == [t for t, _ in sorted(titles)[:5]]


@pytest.mark.parametrize("name", list(gold.GOLD_TABLES))
def test_independent_of_partitioning(spark, bronze, tables, name):
    other = build_silver(bronze.repartition(5, "rating"), FIXED)
    assert rows(gold.build(name, other, RULES)) == rows(tables[name])


@pytest.mark.parametrize("name", list(gold.GOLD_TABLES))
def test_empty_silver(silver, name):
    empty = gold.build(name, silver.limit(0), RULES).collect()
    if name != "content_overview":
        assert empty == []
        return
    row = empty[0]
    assert (row.total_content_count, row.total_movies, row.unique_genres) == (0, 0, 0)
    assert row.avg_quality_score is None and row.movie_percentage is None
    assert row.high_quality_content_count is None


def test_parameters_change_columns(silver):
    other = GoldRules(since_year=2018, added_years=(2018, 2017))
    assert "added_since_2018" in gold.build("genre_analysis", silver, other).columns
    columns = gold.build("geographic_distribution", silver, other).columns
    assert columns[6:8] == ["added_2018", "added_2017"] and "added_2019" not in columns


def test_report_order(tables):
    for name, key in (("genre_analysis", "content_count"), ("rating_distribution", "content_count")):
        counts = [r[key] for r in gold.in_report_order(name, tables[name]).collect()]
        assert counts == sorted(counts, reverse=True)


def test_repeated_ids_are_refused(silver):
    with pytest.raises(ValueError, match="not unique"):
        gold.build("content_overview", silver.union(silver))


def test_declared_order_picks_the_first_of_contradicting_rows(silver):
    assert silver.where("title LIKE '%(again)' AND title NOT LIKE ' (again)'").count() == 0
