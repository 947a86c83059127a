"""Reports over ``rating_distribution``; only allow-listed ratings take part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.config import VALID_RATINGS
from stratalog.functions.measures import exact_mean, guarded_percent, steps
from stratalog.operators import aggregates, joins, ranking, rows

MATURE = "Mature Audiences"


def selected(
    ratings: DataFrame,
    content_types: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    valid: Sequence[str] = VALID_RATINGS,
) -> DataFrame:
    kept = rows.keep_in(ratings, "rating", valid)
    kept = rows.keep_in(kept, "content_type", content_types)
    return rows.keep_in(kept, "rating_category", categories)


def kpis(ratings: DataFrame, **selection) -> DataFrame:
    mature = F.when(F.col("rating_category") == MATURE, F.col("content_count")).otherwise(0)
    by_rating = (
        selected(ratings, **selection)
        .groupBy("rating")
        .agg(
            F.sum("content_count").alias("titles"),
            F.sum(mature).alias("mature"),
            F.sum(steps("avg_quality_score", 3)).alias("score_steps"),
            F.count("avg_quality_score").alias("scored"),
        )
    )
    return by_rating.agg(
        F.count(F.lit(1)).alias("unique_ratings"),
        aggregates.arg_max("rating", "titles").alias("top_rating"),
        F.max("titles").alias("top_rating_titles"),
        guarded_percent(F.sum("mature"), F.sum("titles")).alias("mature_pct"),
        F.sum("mature").alias("mature_titles"),
        F.try_divide(F.sum("score_steps").cast("double"), F.sum("scored") * 1000.0).alias(
            "avg_quality_score"
        ),
    )


def top_ratings(ratings: DataFrame, n: int = 10, **selection) -> DataFrame:
    totals = (
        selected(ratings, **selection)
        .groupBy("rating")
        .agg(
            F.sum("content_count").alias("content_count"),
            aggregates.first_known("rating_category").alias("rating_category"),
        )
    )
    return ranking.top_n(totals, "content_count", n, ["rating"])


def top_rating_counts(ratings: DataFrame, n: int = 8, **selection) -> DataFrame:
    totals = aggregates.group_totals(
        selected(ratings, **selection), ["rating"], ["content_count"]
    )
    return ranking.top_n(totals, "content_count", n, ["rating"])


def category_breakdown(ratings: DataFrame, **selection) -> DataFrame:
    return (
        selected(ratings, **selection)
        .groupBy("rating_category")
        .agg(
            F.sum("content_count").alias("content_count"),
            exact_mean("avg_quality_score", 3).alias("avg_quality_score"),
        )
    )


def type_split(ratings: DataFrame, top: int = 10, n: int = 20, **selection) -> DataFrame:
    chosen = selected(ratings, **selection).select("rating", "content_type", "content_count")
    of_top = joins.keep_top_groups(chosen, "rating", "content_count", top)
    return ranking.top_n(of_top, "content_count", n, ["rating", "content_type"])


def _mean_by_rating(ratings: DataFrame, measure: str, n: int, **selection) -> DataFrame:
    means = (
        rows.keep_not_null(selected(ratings, **selection), [measure])
        .groupBy("rating")
        .agg(
            exact_mean(measure, 1).alias(measure),
            F.sum("content_count").alias("content_count"),
        )
    )
    largest = ranking.top_n(means, "content_count", n, ["rating"])
    return ranking.order_desc(largest, measure, ["rating"])


def mean_duration(ratings: DataFrame, n: int = 10, **selection) -> DataFrame:
    """Mean duration of the most frequent ratings; it mixes minutes and seasons across types."""
    return _mean_by_rating(ratings, "avg_duration_value", n, **selection)


def mean_age(ratings: DataFrame, n: int = 10, **selection) -> DataFrame:
    return _mean_by_rating(ratings, "avg_content_age_years", n, **selection)


def recent_share(ratings: DataFrame, n: int = 15, **selection) -> DataFrame:
    totals = aggregates.group_totals(
        selected(ratings, **selection), ["rating"], ["recent_content_count", "content_count"]
    )
    shares = totals.withColumn(
        "recent_percentage", guarded_percent("recent_content_count", "content_count")
    )
    largest = ranking.top_n(shares, "content_count", n, ["rating"])
    return ranking.order_desc(largest, "recent_content_count", ["rating"])


def table(ratings: DataFrame, **selection) -> DataFrame:
    groups = ["rating", "rating_category", "content_type"]
    totals = (
        selected(ratings, **selection)
        .groupBy(*groups)
        .agg(
            F.sum("content_count").alias("content_count"),
            exact_mean("percentage_of_type", 2).alias("percentage_of_type"),
            exact_mean("avg_quality_score", 3).alias("avg_quality_score"),
            F.sum("recent_content_count").alias("recent_content_count"),
            exact_mean("avg_content_age_years", 1).alias("avg_content_age_years"),
            exact_mean("avg_duration_value", 1).alias("avg_duration_value"),
        )
    )
    # Display labels.
    labels = [
        "Rating", "Category", "Type", "Count", "Type %", "Quality", "Recent", "Age (Y)",
        "Duration",
    ]
    return rows.relabel(ranking.order_desc(totals, "content_count", groups), labels)
