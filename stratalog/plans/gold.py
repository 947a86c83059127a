"""Silver to gold: seven aggregate tables.

Silver holds one row per ``show_id`` (see :func:`stratalog.plans.silver.silver`), so rows are
counted instead of distinct ids: one hash aggregation with map-side combine per table.
:func:`build` makes sure of it unless the caller has.

The builders leave the rows unsorted, for the sinks; :func:`in_report_order` sorts for readers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.config import MOVIE, TV_SHOW, UNCATEGORIZED, UNKNOWN, GoldRules
from stratalog.functions import dates, quality
from stratalog.functions.measures import (
    count_where,
    mean_score,
    percent,
    score_points,
    share_where,
)
from stratalog.operators import aggregates, distincts, joins, ranking, windows
from stratalog.schema import GOLD_COLUMNS

SCORE_PLACES = 3
YEARS_PLACES = 1
PERCENT_PLACES = 2


def _titles() -> Column:
    return F.count(F.lit(1))


def _score(rules: GoldRules) -> Column:
    return F.round(mean_score("data_quality_score", rules.score_points), SCORE_PLACES)


def _mean_years(name: str) -> Column:
    return F.round(F.avg(name), YEARS_PLACES)


def _share(condition: Column) -> Column:
    return F.round(share_where(condition), PERCENT_PLACES)


def content_overview(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """One row of headline figures."""
    return overview_of(overview_parts(silver, rules), rules)


def overview_parts(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """What the overview needs of each country and genre."""
    score, added, year, age = (
        F.col(c)
        for c in ("data_quality_score", "date_added", "release_year", "content_age_years")
    )
    return silver.groupBy("primary_country", "primary_genre").agg(
        _titles().alias("titles"),
        count_where(F.col("content_type") == MOVIE).alias("movies"),
        count_where(F.col("content_type") == TV_SHOW).alias("series"),
        F.sum(score_points(score, rules.score_points)).alias("points"),
        F.count(score).alias("scored"),
        count_where(score >= rules.high_quality_min).alias("high"),
        count_where(F.col("has_director")).alias("directed"),
        count_where(F.col("has_cast")).alias("casted"),
        count_where(F.col("is_recent")).alias("recent"),
        F.min(added).alias("first_added"),
        F.max(added).alias("last_added"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.sum(age).alias("age_sum"),
        F.count(age).alias("aged"),
    )


def overview_of(parts: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """The overview from a row per country and genre.

    The two distinct counts, which make Spark repeat their input, run over those few rows.
    """

    # A sum over nothing is null; the counts of distinct titles are 0 there.
    def total(part: str) -> Column:
        return F.coalesce(F.sum(part), F.lit(0))

    points = total("scored") * float(rules.score_points)
    overview = parts.agg(
        dates.run_date(rules.report_date).alias("report_date"),
        total("titles").alias("total_content_count"),
        total("movies").alias("total_movies"),
        total("series").alias("total_tv_shows"),
        F.round(F.try_divide(F.sum("points").cast("double"), points), SCORE_PLACES).alias(
            "avg_quality_score"
        ),
        F.sum("high").alias("high_quality_content_count"),
        F.sum("directed").alias("content_with_director"),
        F.sum("casted").alias("content_with_cast"),
        F.sum("recent").alias("recent_content_count"),
        F.min("first_added").alias("earliest_content_added"),
        F.max("last_added").alias("latest_content_added"),
        F.min("first_year").alias("oldest_release_year"),
        F.max("last_year").alias("newest_release_year"),
        F.round(
            F.try_divide(F.sum("age_sum").cast("double"), total("aged").cast("double")),
            YEARS_PLACES,
        ).alias("avg_content_age_years"),
        F.count_distinct("primary_country").alias("unique_countries"),
        F.count_distinct("primary_genre").alias("unique_genres"),
    )
    shares = {
        "movie_percentage": "total_movies",
        "tv_show_percentage": "total_tv_shows",
        "high_quality_percentage": "high_quality_content_count",
        "director_completeness_pct": "content_with_director",
    }
    return overview.withColumns(
        {
            name: F.round(percent(part, "total_content_count"), PERCENT_PLACES)
            for name, part in shares.items()
        }
    )


def genre_analysis(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """Per genre and type; shares refer to the groups that reach the minimum size."""
    groups = (
        silver.filter(F.col("primary_genre") != UNCATEGORIZED)
        .groupBy("primary_genre", "content_type")
        .agg(
            _titles().alias("content_count"),
            _score(rules).alias("avg_quality_score"),
            F.min("release_year").alias("earliest_release_year"),
            F.max("release_year").alias("latest_release_year"),
            _mean_years("content_age_years").alias("avg_content_age_years"),
            count_where(F.col("is_recent")).alias("recent_content_count"),
            count_where(F.col("added_year") >= rules.since_year).alias(
                f"added_since_{rules.since_year}"
            ),
            _mean_years("duration_value").alias("avg_duration_value"),
            _share(F.col("has_director")).alias("director_completeness_pct"),
            _share(F.col("has_cast")).alias("cast_completeness_pct"),
        )
    )
    large = aggregates.having_at_least(groups, "content_count", rules.genre_min_titles)
    return windows.share_of_group(large, ["content_type"], "content_count", "percentage_of_type")


def geographic_distribution(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """Per country and type; shares refer to the groups that reach the minimum size."""
    added = {
        f"added_{y}": count_where(F.col("added_year") == y).alias(f"added_{y}")
        for y in rules.added_years
    }
    groups = (
        silver.filter(F.col("primary_country") != UNKNOWN)
        .groupBy("primary_country", "content_type")
        .agg(
            _titles().alias("content_count"),
            count_where(F.col("content_type") == MOVIE).alias("movie_count"),
            count_where(F.col("content_type") == TV_SHOW).alias("tv_show_count"),
            _score(rules).alias("avg_quality_score"),
            *added.values(),
            count_where(F.col("is_recent")).alias("recent_content_count"),
            _mean_years("content_age_years").alias("avg_content_age_years"),
        )
    )
    large = aggregates.having_at_least(groups, "content_count", rules.country_min_titles)
    # A country has a row per type at most, so the window is as good as a join to its totals.
    return windows.share_of_group(
        large, ["primary_country"], "content_count", "percentage_of_country"
    )


def temporal_trends(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """Per month of addition and type, with the running total of the type."""
    months = (
        silver.filter(F.col("date_added").isNotNull())
        .groupBy("added_year", "added_month", "content_type")
        .agg(
            _titles().alias("content_added_count"),
            _score(rules).alias("avg_quality_score"),
            _mean_years("content_age_years").alias("avg_age_of_content_added"),
        )
        .withColumn("month_name", dates.month_name("added_month"))
    )
    return windows.accumulate(
        months,
        ["content_type"],
        ["added_year", "added_month"],
        "content_added_count",
        "cumulative_content_count",
    )


def rating_distribution(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """Per rating and type, with the audience category of the rating."""
    groups = (
        silver.filter(F.col("rating").isNotNull())
        .groupBy("rating", "content_type")
        .agg(
            _titles().alias("content_count"),
            _score(rules).alias("avg_quality_score"),
            count_where(F.col("is_recent")).alias("recent_content_count"),
            _mean_years("content_age_years").alias("avg_content_age_years"),
            _mean_years("duration_value").alias("avg_duration_value"),
        )
        .withColumn(
            "rating_category",
            quality.category("rating", rules.rating_categories, rules.other_category),
        )
    )
    return windows.share_of_group(groups, ["content_type"], "content_count", "percentage_of_type")


def with_quality_tier(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    return silver.withColumn(
        "quality_tier", quality.tier("data_quality_score", rules.tiers, rules.lowest_tier)
    )


def sample_titles(tiered: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """The alphabetically first titles of each type and tier, as a list."""
    groups = ["content_type", "quality_tier"]
    first = windows.top_k(
        tiered, groups, [F.col("title"), F.col("show_id")], rules.sample_titles, "rn"
    )
    return first.groupBy(*groups).agg(
        aggregates.list_in_order("title", "rn").alias("sample_titles")
    )


def quality_scorecard(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """Per type and quality tier, with field completeness and sample titles."""
    groups = ["content_type", "quality_tier"]
    tiered = with_quality_tier(silver, rules)
    scores = tiered.groupBy(*groups).agg(
        _titles().alias("content_count"),
        _score(rules).alias("avg_quality_score"),
        _share(F.col("has_director")).alias("has_director_pct"),
        _share(F.col("has_cast")).alias("has_cast_pct"),
        F.count("duration_value").alias("has_duration_count"),
        F.count("date_added").alias("has_date_added_count"),
        F.count("release_year").alias("has_release_year_count"),
    )
    with_samples = joins.attach(scores, sample_titles(tiered, rules), groups)
    return windows.share_of_group(
        with_samples, ["content_type"], "content_count", "percentage_of_type"
    )


def top_producers(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """Single directors per type, ranked by number of titles."""
    parts = (
        single_directors(silver)
        .groupBy("director", "content_type", "primary_genre")
        .agg(
            _titles().alias("titles"),
            F.sum(score_points("data_quality_score", rules.score_points)).alias("points"),
            F.count("data_quality_score").alias("scored"),
            F.min("release_year").alias("first_year"),
            F.max("release_year").alias("last_year"),
            count_where(F.col("is_recent")).alias("recent"),
        )
    )
    return producers_of(parts, rules)


def single_directors(df: DataFrame) -> DataFrame:
    return df.filter((F.col("director") != UNKNOWN) & ~F.col("director").contains(","))


def producers_of(parts: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """The ranking from a row per director, type and genre.

    These rows get the totals of their director. Sets, which cannot be combined in place, are built of the
    ranked directors' rows only.
    """
    director = ["director", "content_type"]
    whole = Window.partitionBy(*director)
    possible = F.sum("scored").over(whole) * float(rules.score_points)
    score = F.try_divide(F.sum("points").over(whole).cast("double"), possible)
    directors = parts.select(
        *director,
        "primary_genre",
        F.sum("titles").over(whole).alias("content_count"),
        # The rounded score is the sort key of the ranking.
        F.round(score, SCORE_PLACES).alias("avg_quality_score"),
        F.min("first_year").over(whole).alias("first_release_year"),
        F.max("last_year").over(whole).alias("latest_release_year"),
        F.sum("recent").over(whole).alias("recent_works_count"),
    )
    repeated = aggregates.having_at_least(directors, "content_count", rules.director_min_titles)
    order = [F.desc("content_count"), F.desc("avg_quality_score"), F.asc("director")]
    rank = F.dense_rank().over(Window.partitionBy("content_type").orderBy(*order))
    ranked = repeated.withColumn("rank_by_volume", rank).filter(
        F.col("rank_by_volume") <= rules.producer_max_rank
    )
    measures = [c for c in ranked.columns if c != "primary_genre"]
    return (
        ranked.groupBy(*measures)
        .agg(aggregates.sorted_set("primary_genre").alias("genres_worked_in"))
        .withColumn("years_active", F.col("latest_release_year") - F.col("first_release_year"))
    )


@dataclass(frozen=True)
class GoldTable:
    """A gold table: its builder and the order in which readers show it."""

    build: Callable[[DataFrame, GoldRules], DataFrame]
    order: tuple[tuple[str, bool], ...]


GOLD_TABLES: dict[str, GoldTable] = {
    "content_overview": GoldTable(content_overview, ()),
    "genre_analysis": GoldTable(
        genre_analysis, (("content_count", False), ("primary_genre", True), ("content_type", True))
    ),
    "geographic_distribution": GoldTable(
        geographic_distribution,
        (("content_count", False), ("primary_country", True), ("content_type", True)),
    ),
    "temporal_trends": GoldTable(
        temporal_trends, (("added_year", False), ("added_month", False), ("content_type", True))
    ),
    "rating_distribution": GoldTable(
        rating_distribution, (("content_count", False), ("rating", True), ("content_type", True))
    ),
    "quality_scorecard": GoldTable(
        quality_scorecard,
        (("content_type", True), ("avg_quality_score", False), ("quality_tier", True)),
    ),
    "top_producers": GoldTable(
        top_producers, (("content_type", True), ("rank_by_volume", True))
    ),
}


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise if a key occurs twice, or is null. Copies are combined before the shuffle."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if not repeated.filter((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is not unique")


def build(
    name: str, silver: DataFrame, rules: GoldRules = GoldRules(), verify_unique: bool = True
) -> DataFrame:
    """A gold table with its columns in the published order.

    Titles are counted by their rows, so ids must be unique; that is verified, at the cost of a job,
    unless the caller knows it.
    """
    if verify_unique:
        assert_unique(silver, "show_id")
    return GOLD_TABLES[name].build(silver, rules).select(*columns_of(name, rules))


def columns_of(name: str, rules: GoldRules = GoldRules()) -> list[str]:
    """The columns of a gold table in the published order; some are named by the rules."""
    columns = GOLD_COLUMNS[name]
    if name == "genre_analysis":
        columns = [c.replace("added_since_2020", f"added_since_{rules.since_year}") for c in columns]
    if name == "geographic_distribution":
        added = [f"added_{y}" for y in rules.added_years]
        start = columns.index("added_2021")
        columns = columns[:start] + added + columns[start + 3 :]
    return list(columns)


def in_report_order(name: str, table: DataFrame) -> DataFrame:
    order = GOLD_TABLES[name].order
    return ranking.order_mixed(table, order) if order else table


DISTINCT_KEYS = ["content_type", "rating", "added_year"]
DISTINCT_COLUMNS = ["primary_country", "primary_genre"]


def distinct_sets(silver: DataFrame) -> DataFrame:
    """Countries and genres of each type, rating and year of addition, as sets that merge.

    Reports count them over any filter of these keys with ``distincts.distinct_counts``, without silver.
    """
    dictionaries = {c: distincts.dense_ids(silver, c) for c in DISTINCT_COLUMNS}
    return distincts.distinct_states(silver, DISTINCT_KEYS, dictionaries)
