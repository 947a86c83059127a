"""Table schemas of the three layers.

Fixed values: names and types must equal those of the published tables.
"""

from __future__ import annotations

from pyspark.sql import types as T

BRONZE_SCHEMA = T.StructType(
    [
        T.StructField("show_id", T.StringType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("director", T.StringType()),
        T.StructField("cast", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("date_added", T.StringType()),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("rating", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("listed_in", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

SILVER_COLUMNS = [
    "show_id", "content_type", "title", "director", "cast_and_crew", "country", "date_added",
    "release_year", "rating", "duration", "genre", "description", "duration_value",
    "duration_unit", "added_year", "added_month", "content_age_years", "primary_genre",
    "primary_country", "has_director", "has_cast", "is_recent", "data_quality_score",
    "processed_timestamp",
]

GOLD_COLUMNS = {
    "content_overview": [
        "report_date", "total_content_count", "total_movies", "total_tv_shows",
        "avg_quality_score", "high_quality_content_count", "content_with_director",
        "content_with_cast", "recent_content_count", "earliest_content_added",
        "latest_content_added", "oldest_release_year", "newest_release_year",
        "avg_content_age_years", "unique_countries", "unique_genres", "movie_percentage",
        "tv_show_percentage", "high_quality_percentage", "director_completeness_pct",
    ],
    "genre_analysis": [
        "primary_genre", "content_type", "content_count", "avg_quality_score",
        "earliest_release_year", "latest_release_year", "avg_content_age_years",
        "recent_content_count", "added_since_2020", "avg_duration_value",
        "director_completeness_pct", "cast_completeness_pct", "percentage_of_type",
    ],
    "geographic_distribution": [
        "primary_country", "content_type", "content_count", "movie_count", "tv_show_count",
        "avg_quality_score", "added_2021", "added_2020", "added_2019", "recent_content_count",
        "avg_content_age_years", "percentage_of_country",
    ],
    "temporal_trends": [
        "added_year", "added_month", "content_type", "content_added_count", "avg_quality_score",
        "avg_age_of_content_added", "month_name", "cumulative_content_count",
    ],
    "rating_distribution": [
        "rating", "content_type", "content_count", "avg_quality_score", "recent_content_count",
        "avg_content_age_years", "avg_duration_value", "rating_category", "percentage_of_type",
    ],
    "quality_scorecard": [
        "content_type", "quality_tier", "content_count", "avg_quality_score", "has_director_pct",
        "has_cast_pct", "has_duration_count", "has_date_added_count", "has_release_year_count",
        "sample_titles", "percentage_of_type",
    ],
    "top_producers": [
        "director", "content_type", "content_count", "avg_quality_score", "genres_worked_in",
        "first_release_year", "latest_release_year", "recent_works_count", "years_active",
        "rank_by_volume",
    ],
}
