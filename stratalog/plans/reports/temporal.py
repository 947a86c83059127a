"""Reports over ``temporal_trends``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import dates
from stratalog.functions.measures import exact_mean, steps
from stratalog.operators import aggregates, ranking, reshape, rows, windows

_COUNT = "content_added_count"


def selected(
    trends: DataFrame,
    first_year: int | None = None,
    last_year: int | None = None,
    content_types: Sequence[str] | None = None,
) -> DataFrame:
    kept = rows.keep_between(trends, "added_year", first_year, last_year)
    return rows.keep_in(kept, "content_type", content_types).withColumn(
        "year_month", dates.first_of_month("added_year", "added_month")
    )


def kpis(trends: DataFrame, **selection) -> DataFrame:
    best = aggregates.row_of_max(
        ["month_name", "added_year", _COUNT, "year_month", "content_type"],
        _COUNT,
        ["year_month", "content_type"],
    )
    months = (
        selected(trends, **selection)
        .groupBy("year_month")
        .agg(
            F.sum(_COUNT).alias("added"),
            F.sum(steps("avg_quality_score", 3)).alias("score_steps"),
            F.count("avg_quality_score").alias("scored"),
            best.alias("best"),
        )
    )
    order = F.struct(-F.col(f"best.{_COUNT}"), F.col("best.year_month"), F.col("best.content_type"))
    figures = months.agg(
        F.sum("added").alias("total_added"),
        F.min_by("best", order).alias("peak"),
        F.avg("added").alias("avg_monthly_additions"),
        F.try_divide(F.sum("score_steps").cast("double"), F.sum("scored") * 1000.0).alias(
            "avg_quality_score"
        ),
    )
    return figures.select(
        "total_added",
        dates.month_label("peak.month_name", "peak.added_year").alias("peak_month"),
        F.col(f"peak.{_COUNT}").alias("peak_month_titles"),
        "avg_monthly_additions",
        "avg_quality_score",
    )


def monthly_timeline(trends: DataFrame, **selection) -> DataFrame:
    return aggregates.group_totals(
        selected(trends, **selection), ["year_month", "content_type"], [_COUNT]
    )


def cumulative_growth(trends: DataFrame, **selection) -> DataFrame:
    """Running total that starts at the first selected month."""
    return windows.running_total(
        selected(trends, **selection), ["content_type"], ["year_month"], _COUNT, "cumulative_count"
    )


def yearly_additions(trends: DataFrame, **selection) -> DataFrame:
    return aggregates.group_totals(
        selected(trends, **selection), ["added_year", "content_type"], [_COUNT]
    )


def yearly_score(trends: DataFrame, **selection) -> DataFrame:
    return (
        selected(trends, **selection)
        .groupBy("added_year", "content_type")
        .agg(exact_mean("avg_quality_score", 3).alias("avg_quality_score"))
    )


def seasonality(trends: DataFrame, **selection) -> DataFrame:
    """Mean additions per calendar month, over the rows of year and type."""
    means = (
        selected(trends, **selection)
        .groupBy("added_month", "month_name")
        .agg(F.avg(_COUNT).alias(_COUNT))
    )
    return means.orderBy("added_month")


def month_year_matrix(
    trends: DataFrame, years: Sequence[int] | None = None, **selection
) -> DataFrame:
    """Calendar months down, years across, 0 where nothing was added."""
    return reshape.pivot_sum(
        selected(trends, **selection), ["added_month"], "added_year", _COUNT, years
    )


def age_at_addition(trends: DataFrame, **selection) -> DataFrame:
    return (
        selected(trends, **selection)
        .groupBy("year_month", "content_type")
        .agg(exact_mean("avg_age_of_content_added", 1).alias("avg_age_of_content_added"))
    )


def top_months(trends: DataFrame, n: int = 20, **selection) -> DataFrame:
    months = (
        selected(trends, **selection)
        .groupBy("added_year", "added_month", "month_name")
        .agg(
            F.sum(_COUNT).alias(_COUNT),
            exact_mean("avg_quality_score", 3).alias("avg_quality_score"),
        )
    )
    largest = ranking.top_n(months, _COUNT, n, ["added_year", "added_month"])
    return largest.withColumn("year_month_label", dates.month_label("month_name", "added_year"))


def table(trends: DataFrame, n: int = 100, **selection) -> DataFrame:
    """The newest months first."""
    totals = (
        selected(trends, **selection)
        .groupBy("added_year", "added_month", "month_name", "content_type")
        .agg(
            F.sum(_COUNT).alias(_COUNT),
            F.max("cumulative_content_count").alias("cumulative_content_count"),
            exact_mean("avg_quality_score", 3).alias("avg_quality_score"),
            exact_mean("avg_age_of_content_added", 1).alias("avg_age_of_content_added"),
        )
    )
    newest = ranking.order_mixed(
        totals, [("added_year", False), ("added_month", False), ("content_type", True)]
    ).limit(n)
    # Display labels.
    labels = ["Year", "Month #", "Month", "Type", "Added", "Cumulative", "Quality", "Avg Age"]
    return rows.relabel(newest, labels)
