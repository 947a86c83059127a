"""Reports over ``content_overview``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.measures import guarded_percent
from stratalog.operators.reshape import to_rows


def headline_kpis(overview: DataFrame) -> DataFrame:
    return overview.select(
        "total_content_count",
        "total_movies",
        "movie_percentage",
        "total_tv_shows",
        "tv_show_percentage",
        "avg_quality_score",
        "unique_countries",
        "unique_genres",
        "avg_content_age_years",
    )


def content_type_shares(overview: DataFrame) -> DataFrame:
    def row(label: str, count: str, share: str) -> dict[str, Column]:
        return {"type": F.lit(label), "count": F.col(count), "percentage": F.col(share)}

    return to_rows(
        overview,
        [
            row("Movies", "total_movies", "movie_percentage"),
            row("TV Shows", "total_tv_shows", "tv_show_percentage"),
        ],
    )


def field_completeness(overview: DataFrame) -> DataFrame:
    cast = guarded_percent("content_with_cast", "total_content_count")
    return to_rows(
        overview,
        [
            {"field": F.lit("Director"), "completeness": F.col("director_completeness_pct")},
            {"field": F.lit("Cast"), "completeness": cast},
        ],
    )


def quality_split(overview: DataFrame) -> DataFrame:
    high = F.col("high_quality_content_count")
    return to_rows(
        overview,
        [
            {"category": F.lit("High Quality"), "count": high},
            {"category": F.lit("Lower Quality"), "count": F.col("total_content_count") - high},
        ],
    )


def summary_table(overview: DataFrame) -> DataFrame:
    """Metric names with display texts, in fixed order of ``position``."""

    def whole(name: str) -> Column:
        return F.format_number(name, 0)

    def tenth(column: Column) -> Column:
        return F.format_number(F.round(column, 1), 1)

    def with_share(count: str, share: str) -> Column:
        return F.concat(whole(count), F.lit(" ("), tenth(F.col(share)), F.lit("%)"))

    score, completeness = F.col("avg_quality_score"), F.col("director_completeness_pct")
    metrics = {
        "Total Content": whole("total_content_count"),
        "Movies": with_share("total_movies", "movie_percentage"),
        "TV Shows": with_share("total_tv_shows", "tv_show_percentage"),
        "High Quality Content": with_share(
            "high_quality_content_count", "high_quality_percentage"
        ),
        "Countries Represented": F.col("unique_countries").cast("string"),
        "Genres Available": F.col("unique_genres").cast("string"),
        "Average Quality Score": F.concat(tenth(score * 100), F.lit("%")),
        "Director Completeness": F.concat(tenth(completeness), F.lit("%")),
        "Average Content Age": F.concat(tenth(F.col("avg_content_age_years")), F.lit(" years")),
    }
    return to_rows(
        overview,
        [
            {"position": F.lit(i), "metric": F.lit(name), "value": value}
            for i, (name, value) in enumerate(metrics.items(), start=1)
        ],
    )
