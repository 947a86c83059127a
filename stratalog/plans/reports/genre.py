"""Reports over ``genre_analysis``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.ranking import top_n
from stratalog.operators.rows import keep_in

Types = Sequence[str] | None
_TIES = ["primary_genre", "content_type"]


def top_by_count(genres: DataFrame, n: int = 10, content_types: Types = None) -> DataFrame:
    rows = keep_in(genres, "content_type", content_types)
    columns = ["primary_genre", "content_type", "content_count", "avg_quality_score"]
    return top_n(rows.select(*columns), "content_count", n, _TIES)


def top_by_score(genres: DataFrame, n: int = 10, content_types: Types = None) -> DataFrame:
    rows = keep_in(genres, "content_type", content_types)
    return top_n(rows.select(*_TIES, "avg_quality_score"), "avg_quality_score", n, _TIES)


def top_by_duration(genres: DataFrame, n: int = 10, content_types: Types = None) -> DataFrame:
    rows = keep_in(genres, "content_type", content_types).filter(F.col("avg_duration_value") > 0)
    return top_n(rows.select(*_TIES, "avg_duration_value"), "avg_duration_value", n, _TIES)


def top_over_types(genres: DataFrame, n: int = 10) -> DataFrame:
    totals = genres.groupBy("primary_genre").agg(F.sum("content_count").alias("total"))
    return top_n(totals, "total", n, ["primary_genre"])


def table(genres: DataFrame, content_types: Types = None) -> DataFrame:
    return keep_in(genres, "content_type", content_types).select(
        "primary_genre",
        "content_type",
        "content_count",
        "avg_quality_score",
        "earliest_release_year",
        "latest_release_year",
    )
