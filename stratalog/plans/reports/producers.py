"""Reports over ``top_producers``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import quality, text
from stratalog.functions.measures import steps
from stratalog.operators import aggregates, ranking, rows

_TIES = ["director", "content_type"]
_COUNT, _SCORE = "content_count", "avg_quality_score"


def selected(
    producers: DataFrame, content_types: Sequence[str] | None = None, min_titles: int = 3
) -> DataFrame:
    kept = rows.keep_in(producers, "content_type", content_types)
    return rows.keep_between(kept, _COUNT, low=min_titles)


def kpis(producers: DataFrame, **selection) -> DataFrame:
    best = aggregates.row_of_max(["director", _COUNT, "content_type"], _COUNT, ["content_type"])
    directors = (
        selected(producers, **selection)
        .groupBy("director")
        .agg(
            F.sum(steps(_SCORE, 3)).alias("score_steps"),
            F.count(_SCORE).alias("scored"),
            F.sum("years_active").alias("years"),
            F.count("years_active").alias("spans"),
            best.alias("best"),
        )
    )
    order = F.struct(-F.col(f"best.{_COUNT}"), F.col("best.director"), F.col("best.content_type"))
    figures = directors.agg(
        F.count(F.lit(1)).alias("total_producers"),
        F.min_by("best", order).alias("top"),
        F.try_divide(F.sum("score_steps").cast("double"), F.sum("scored") * 1000.0).alias(_SCORE),
        F.try_divide(F.sum("years").cast("double"), F.sum("spans").cast("double")).alias(
            "avg_years_active"
        ),
    )
    return figures.select(
        "total_producers",
        F.col("top.director").alias("most_prolific"),
        F.col(f"top.{_COUNT}").alias("most_prolific_titles"),
        _SCORE,
        "avg_years_active",
    )


def top_by_count(producers: DataFrame, n: int = 20, **selection) -> DataFrame:
    chosen = selected(producers, **selection).select(*_TIES, _COUNT)
    return ranking.top_n(chosen, _COUNT, n, _TIES)


def top_by_score(
    producers: DataFrame, n: int = 15, min_group_titles: int = 5, **selection
) -> DataFrame:
    chosen = rows.keep_between(selected(producers, **selection), _COUNT, low=min_group_titles)
    return ranking.top_n(chosen.select(*_TIES, _COUNT, _SCORE), _SCORE, n, _TIES)


def productivity_and_score(
    producers: DataFrame, min_group_titles: int = 3, **selection
) -> DataFrame:
    chosen = rows.keep_between(selected(producers, **selection), _COUNT, low=min_group_titles)
    return chosen.select(*_TIES, _COUNT, _SCORE)


def career_spans(producers: DataFrame, n: int = 20, **selection) -> DataFrame:
    active = selected(producers, **selection).filter(F.col("years_active") > 0)
    return ranking.top_n(active.select(*_TIES, _COUNT, "years_active"), _COUNT, n, _TIES)


def career_timeline(
    producers: DataFrame, n: int = 15, min_group_titles: int = 5, **selection
) -> DataFrame:
    chosen = rows.keep_between(selected(producers, **selection), _COUNT, low=min_group_titles)
    columns = [*_TIES, _COUNT, "first_release_year", "latest_release_year"]
    return ranking.top_n(chosen.select(*columns), _COUNT, n, _TIES)


def with_genre_count(producers: DataFrame) -> DataFrame:
    return producers.withColumn("genre_count", F.size("genres_worked_in"))


def genre_diversity(
    producers: DataFrame, n: int = 15, min_group_titles: int = 5, **selection
) -> DataFrame:
    chosen = rows.keep_between(selected(producers, **selection), _COUNT, low=min_group_titles)
    counted = with_genre_count(chosen).select(*_TIES, _COUNT, "genre_count")
    return ranking.top_n(counted, "genre_count", n, _TIES)


def producer_types(producers: DataFrame, **selection) -> DataFrame:
    typed = with_genre_count(selected(producers, **selection)).withColumn(
        "producer_type", quality.producer_type("genre_count")
    )
    return aggregates.group_totals(typed, ["producer_type"], [_COUNT])


def recently_active(producers: DataFrame, n: int = 20, **selection) -> DataFrame:
    recent = selected(producers, **selection).filter(F.col("recent_works_count") > 0)
    return ranking.top_n(
        recent.select(*_TIES, "recent_works_count"), "recent_works_count", n, _TIES
    )


def search(
    producers: DataFrame, query: str, n: int = 10, pattern: bool = False, **selection
) -> DataFrame:
    """First matches by rank; ``query`` is literal text unless ``pattern`` is set."""
    test = text.matches_ignore_case if pattern else text.contains_ignore_case
    found = selected(producers, **selection).filter(test("director", query))
    order = [("content_type", True), ("rank_by_volume", True)]
    return ranking.order_mixed(found, order).limit(n)


def table(producers: DataFrame, n: int = 100, **selection) -> DataFrame:
    columns = [
        "director", "content_type", _COUNT, _SCORE, "first_release_year", "latest_release_year",
        "years_active", "recent_works_count", "rank_by_volume",
    ]
    # Display labels.
    labels = [
        "Director", "Type", "Content", "Quality", "First Year", "Latest Year", "Years Active",
        "Recent", "Rank",
    ]
    largest = ranking.top_n(selected(producers, **selection).select(*columns), _COUNT, n, _TIES)
    return rows.relabel(largest, labels)
