"""Reports over ``geographic_distribution``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.measures import exact_mean, guarded_percent, steps, weighted_mean
from stratalog.operators import aggregates, joins, ranking, reshape, rows

Types = Sequence[str] | None
_COUNTRY = "primary_country"


def selected(geo: DataFrame, content_types: Types = None, min_titles: int = 10) -> DataFrame:
    kept = rows.keep_in(geo, "content_type", content_types)
    return rows.keep_between(kept, "content_count", low=min_titles)


def kpis(geo: DataFrame, content_types: Types = None, min_titles: int = 10) -> DataFrame:
    """Countries and top country of all rows; mean score and additions of the selected rows."""
    chosen = F.col("content_count") >= min_titles
    if content_types is not None:
        chosen = chosen & F.col("content_type").isin(*content_types)
    score = F.when(chosen, F.col("avg_quality_score"))
    countries = geo.groupBy(_COUNTRY).agg(
        F.sum("content_count").alias("titles"),
        F.sum(steps(score, 3)).alias("score_steps"),
        F.count(score).alias("scored"),
        F.sum(F.when(chosen, F.col("added_2021")).otherwise(0)).alias("added_2021"),
    )
    return countries.agg(
        F.count(F.lit(1)).alias("total_countries"),
        aggregates.arg_max(_COUNTRY, "titles").alias("top_country"),
        F.max("titles").alias("top_country_titles"),
        F.try_divide(F.sum("score_steps").cast("double"), F.sum("scored") * 1000.0).alias(
            "avg_quality_score"
        ),
        F.sum("added_2021").alias("added_2021"),
    )


def _volume_and_score(chosen: DataFrame, weighted: bool = False) -> DataFrame:
    score = (
        weighted_mean("avg_quality_score", "content_count", 3)
        if weighted
        else exact_mean("avg_quality_score", 3)
    )
    return chosen.groupBy(_COUNTRY).agg(
        F.sum("content_count").alias("content_count"), score.alias("avg_quality_score")
    )


def top_countries(
    geo: DataFrame, n: int = 15, weighted: bool = False, **selection
) -> DataFrame:
    """Largest countries with the mean score of their types, weighted by titles on request."""
    totals = _volume_and_score(selected(geo, **selection), weighted)
    return ranking.top_n(totals, "content_count", n, [_COUNTRY])


def type_split(geo: DataFrame, countries: int = 10, n: int = 20, **selection) -> DataFrame:
    chosen = selected(geo, **selection).select(_COUNTRY, "content_type", "content_count")
    of_top = joins.keep_top_groups(chosen, _COUNTRY, "content_count", countries)
    return ranking.top_n(of_top, "content_count", n, [_COUNTRY, "content_type"])


def movie_share(geo: DataFrame, n: int = 10, **selection) -> DataFrame:
    totals = aggregates.group_totals(
        selected(geo, **selection), [_COUNTRY], ["movie_count", "tv_show_count", "content_count"]
    )
    shares = totals.withColumn("movie_pct", guarded_percent("movie_count", "content_count"))
    largest = ranking.top_n(shares, "content_count", n, [_COUNTRY])
    return ranking.order_desc(largest, "movie_pct", [_COUNTRY])


def top_by_score(
    geo: DataFrame, n: int = 15, min_group_titles: int = 20, **selection
) -> DataFrame:
    chosen = rows.keep_between(selected(geo, **selection), "content_count", low=min_group_titles)
    return ranking.top_n(_volume_and_score(chosen), "avg_quality_score", n, [_COUNTRY])


def volume_and_score(geo: DataFrame, **selection) -> DataFrame:
    return _volume_and_score(selected(geo, **selection))


def additions_by_year(
    geo: DataFrame, n: int = 10, years: Sequence[int] = (2019, 2020, 2021), **selection
) -> DataFrame:
    """Long form: one row per country and year."""
    added = [f"added_{y}" for y in years]
    totals = aggregates.group_totals(
        selected(geo, **selection), [_COUNTRY], [*added, "content_count"]
    )
    largest = ranking.top_n(totals, "content_count", n, [_COUNTRY])
    return reshape.unpivot(largest, [_COUNTRY], added, "year", "content_added", "added_")


def mean_age(geo: DataFrame, n: int = 15, **selection) -> DataFrame:
    ages = (
        selected(geo, **selection)
        .groupBy(_COUNTRY)
        .agg(
            exact_mean("avg_content_age_years", 1).alias("avg_content_age_years"),
            F.sum("content_count").alias("content_count"),
        )
    )
    largest = ranking.top_n(ages, "content_count", n, [_COUNTRY])
    return ranking.order_desc(largest, "avg_content_age_years", [_COUNTRY])


def table(geo: DataFrame, **selection) -> DataFrame:
    totals = (
        selected(geo, **selection)
        .groupBy(_COUNTRY)
        .agg(
            F.sum("content_count").alias("content_count"),
            F.sum("movie_count").alias("movie_count"),
            F.sum("tv_show_count").alias("tv_show_count"),
            exact_mean("avg_quality_score", 3).alias("avg_quality_score"),
            F.sum("added_2021").alias("added_2021"),
            exact_mean("avg_content_age_years", 1).alias("avg_content_age_years"),
        )
    )
    # Display labels.
    labels = [
        "Country", "Total Content", "Movies", "TV Shows", "Avg Quality", "Added 2021",
        "Avg Age (Years)",
    ]
    return rows.relabel(ranking.order_desc(totals, "content_count", [_COUNTRY]), labels)
