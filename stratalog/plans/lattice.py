"""All gold tables from states that can be merged: silver is scanned once for them, once for sample titles.

One aggregation, over two sets of keys, leaves a row of counts, sums and extremes for each combination of
type, genre, country, rating, month of addition and score, and for each director, type and genre. They are
written, and every table is rolled up from them. Sums are of whole numbers, so a rolled-up mean equals that
of the titles. The rows grow with the combinations that occur, not with the titles of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.config import MOVIE, TV_SHOW, UNCATEGORIZED, UNKNOWN, GoldRules
from stratalog.functions import dates, quality
from stratalog.functions.measures import count_where, score_points
from stratalog.operators import aggregates, joins, windows
from stratalog.plans import gold

CELL_KEYS = ["content_type", "primary_genre", "primary_country", "rating", "added_year", "added_month", "data_quality_score"]
PRODUCER_KEYS = ["director", "content_type", "primary_genre"]
SUMS = ["titles", "points", "scored", "recent", "directed", "casted", "age_sum", "aged", "length_sum", "lengths", "dated", "yeared"]
LEAST, MOST = ["first_added", "first_year"], ["last_added", "last_year"]


def state_table(silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """Cells and producers in one table; ``producer`` tells them apart."""
    keys = [*CELL_KEYS, "director"]
    # The score is a key and is summed up too; a key is null in the rows of the other set.
    scored = silver.withColumn("_score", F.col("data_quality_score"))
    return scored.groupingSets([CELL_KEYS, PRODUCER_KEYS], *keys).agg(
        (F.grouping("rating") == 1).alias("producer"),
        F.count(F.lit(1)).alias("titles"),
        F.sum(score_points("_score", rules.score_points)).alias("points"),
        F.count("_score").alias("scored"),
        count_where(F.col("is_recent")).alias("recent"),
        count_where(F.col("has_director")).alias("directed"),
        count_where(F.col("has_cast")).alias("casted"),
        F.sum("content_age_years").alias("age_sum"),
        F.count("content_age_years").alias("aged"),
        F.sum("duration_value").alias("length_sum"),
        F.count("duration_value").alias("lengths"),
        F.count("date_added").alias("dated"),
        F.count("release_year").alias("yeared"),
        F.min("date_added").alias("first_added"),
        F.max("date_added").alias("last_added"),
        F.min("release_year").alias("first_year"),
        F.max("release_year").alias("last_year"),
    )


def merged(tables: DataFrame) -> DataFrame:
    """States of several parts of silver, with one title in one part only, as those of the whole."""
    return tables.groupBy(*CELL_KEYS, "director", "producer").agg(*_merge(SUMS, F.sum), *_merge(LEAST, F.min), *_merge(MOST, F.max))


def _merge(names: list[str], how) -> list[Column]:
    return [how(c).alias(c) for c in names]


def _titles_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("titles")).otherwise(0))


def _score(rules: GoldRules) -> Column:
    possible = F.sum("scored") * float(rules.score_points)
    return F.round(F.try_divide(F.sum("points").cast("double"), possible), gold.SCORE_PLACES)


def _mean(total: str, count: str) -> Column:
    return F.round(F.try_divide(F.sum(total).cast("double"), F.sum(count).cast("double")), gold.YEARS_PLACES)


def _share(part: str) -> Column:
    return F.round(F.sum(part).cast("double") / F.sum("titles") * 100, gold.PERCENT_PLACES)


def _count() -> Column:
    return F.sum("titles").alias("content_count")


def content_overview(cells: DataFrame, rules: GoldRules) -> DataFrame:
    parts = cells.groupBy("primary_country", "primary_genre").agg(
        _titles_where(F.col("content_type") == MOVIE).alias("movies"),
        _titles_where(F.col("content_type") == TV_SHOW).alias("series"),
        _titles_where(F.col("data_quality_score") >= rules.high_quality_min).alias("high"),
        *_merge(SUMS, F.sum), *_merge(LEAST, F.min), *_merge(MOST, F.max),
    )
    return gold.overview_of(parts, rules)


def genre_analysis(cells: DataFrame, rules: GoldRules) -> DataFrame:
    groups = (
        cells.filter(F.col("primary_genre") != UNCATEGORIZED)
        .groupBy("primary_genre", "content_type")
        .agg(
            _count(),
            _score(rules).alias("avg_quality_score"),
            F.min("first_year").alias("earliest_release_year"),
            F.max("last_year").alias("latest_release_year"),
            _mean("age_sum", "aged").alias("avg_content_age_years"),
            F.sum("recent").alias("recent_content_count"),
            _titles_where(F.col("added_year") >= rules.since_year).alias(f"added_since_{rules.since_year}"),
            _mean("length_sum", "lengths").alias("avg_duration_value"),
            _share("directed").alias("director_completeness_pct"),
            _share("casted").alias("cast_completeness_pct"),
        )
    )
    large = aggregates.having_at_least(groups, "content_count", rules.genre_min_titles)
    return windows.share_of_group(large, ["content_type"], "content_count", "percentage_of_type")


def geographic_distribution(cells: DataFrame, rules: GoldRules) -> DataFrame:
    groups = (
        cells.filter(F.col("primary_country") != UNKNOWN)
        .groupBy("primary_country", "content_type")
        .agg(
            _count(),
            _titles_where(F.col("content_type") == MOVIE).alias("movie_count"),
            _titles_where(F.col("content_type") == TV_SHOW).alias("tv_show_count"),
            _score(rules).alias("avg_quality_score"),
            *[_titles_where(F.col("added_year") == y).alias(f"added_{y}") for y in rules.added_years],
            F.sum("recent").alias("recent_content_count"),
            _mean("age_sum", "aged").alias("avg_content_age_years"),
        )
    )
    large = aggregates.having_at_least(groups, "content_count", rules.country_min_titles)
    return windows.share_of_group(large, ["primary_country"], "content_count", "percentage_of_country")


def temporal_trends(cells: DataFrame, rules: GoldRules) -> DataFrame:
    months = (
        cells.filter(F.col("added_year").isNotNull())
        .groupBy("added_year", "added_month", "content_type")
        .agg(
            F.sum("titles").alias("content_added_count"),
            _score(rules).alias("avg_quality_score"),
            _mean("age_sum", "aged").alias("avg_age_of_content_added"),
        )
        .withColumn("month_name", dates.month_name("added_month"))
    )
    order = ["added_year", "added_month"]
    return windows.accumulate(months, ["content_type"], order, "content_added_count", "cumulative_content_count")


def rating_distribution(cells: DataFrame, rules: GoldRules) -> DataFrame:
    groups = (
        cells.filter(F.col("rating").isNotNull())
        .groupBy("rating", "content_type")
        .agg(
            _count(),
            _score(rules).alias("avg_quality_score"),
            F.sum("recent").alias("recent_content_count"),
            _mean("age_sum", "aged").alias("avg_content_age_years"),
            _mean("length_sum", "lengths").alias("avg_duration_value"),
        )
        .withColumn("rating_category", quality.category("rating", rules.rating_categories, rules.other_category))
    )
    return windows.share_of_group(groups, ["content_type"], "content_count", "percentage_of_type")


def quality_scorecard(cells: DataFrame, samples: DataFrame, rules: GoldRules) -> DataFrame:
    groups = ["content_type", "quality_tier"]
    scores = gold.with_quality_tier(cells, rules).groupBy(*groups).agg(
        _count(),
        _score(rules).alias("avg_quality_score"),
        _share("directed").alias("has_director_pct"),
        _share("casted").alias("has_cast_pct"),
        F.sum("lengths").alias("has_duration_count"),
        F.sum("dated").alias("has_date_added_count"),
        F.sum("yeared").alias("has_release_year_count"),
    )
    with_samples = joins.attach(scores, samples, groups)
    return windows.share_of_group(with_samples, ["content_type"], "content_count", "percentage_of_type")


def build(name: str, table: DataFrame, silver: DataFrame, rules: GoldRules = GoldRules()) -> DataFrame:
    """A gold table from ``table``, the states of ``silver``; only the scorecard reads silver, for its samples."""
    cells = table.filter(~F.col("producer"))
    if name == "top_producers":
        parts = gold.single_directors(table.filter("producer"))
        result = gold.producers_of(parts.select(*PRODUCER_KEYS, "titles", "points", "scored", "first_year", "last_year", "recent"), rules)
    elif name == "quality_scorecard":
        result = quality_scorecard(cells, gold.sample_titles(gold.with_quality_tier(silver, rules), rules), rules)
    else:
        result = ROLLED_UP[name](cells, rules)
    return result.select(*gold.columns_of(name, rules))


ROLLED_UP = {
    "content_overview": content_overview,
    "genre_analysis": genre_analysis,
    "geographic_distribution": geographic_distribution,
    "temporal_trends": temporal_trends,
    "rating_distribution": rating_distribution,
}
