"""Reports over ``quality_scorecard``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.config import GoldRules
from stratalog.functions.measures import exact_mean, guarded_percent, weighted_mean
from stratalog.operators import aggregates, ranking, reshape, rows

Types = Sequence[str] | None
TIER_ORDER = GoldRules().tier_order
_TIER, _TYPE, _COUNT = "quality_tier", "content_type", "content_count"


def selected(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    return rows.keep_in(scorecard, _TYPE, content_types)


def kpis(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    def titles(tier: str):
        return F.sum(F.when(F.col(_TIER) == tier, F.col(_COUNT)).otherwise(0))

    excellent, good = titles(TIER_ORDER[0]), titles(TIER_ORDER[1])
    return selected(scorecard, content_types).agg(
        guarded_percent(excellent, F.sum(_COUNT)).alias("excellent_pct"),
        excellent.alias("excellent_titles"),
        guarded_percent(good, F.sum(_COUNT)).alias("good_pct"),
        good.alias("good_titles"),
        exact_mean("avg_quality_score", 3).alias("avg_quality_score"),
        exact_mean("has_director_pct", 2).alias("avg_director_completeness"),
    )


def tier_totals(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    return aggregates.group_totals(selected(scorecard, content_types), [_TIER], [_COUNT])


def tier_type_totals(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    return aggregates.group_totals(selected(scorecard, content_types), [_TYPE, _TIER], [_COUNT])


def rows_per_tier(scorecard: DataFrame) -> DataFrame:
    return aggregates.count_rows(scorecard, [_TIER], "records")


def tier_scores(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    """Mean score and titles per tier, best tier first."""
    tiers = (
        selected(scorecard, content_types)
        .groupBy(_TIER)
        .agg(
            exact_mean("avg_quality_score", 3).alias("avg_quality_score"),
            F.sum(_COUNT).alias(_COUNT),
        )
    )
    return ranking.order_custom(tiers, _TIER, TIER_ORDER)


def completeness_by_tier(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    """Mean director and cast completeness, each beside its own tier."""
    tiers = (
        selected(scorecard, content_types)
        .groupBy(_TIER)
        .agg(
            exact_mean("has_director_pct", 2).alias("director_completeness"),
            exact_mean("has_cast_pct", 2).alias("cast_completeness"),
        )
    )
    return ranking.order_custom(tiers, _TIER, TIER_ORDER)


def field_matrix(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    """One row per field, one column per tier; null for a tier without titles."""
    tiers = (
        selected(scorecard, content_types)
        .groupBy(_TIER)
        .agg(
            exact_mean("has_director_pct", 2).alias("director"),
            exact_mean("has_cast_pct", 2).alias("cast"),
            guarded_percent(F.sum("has_duration_count"), F.sum(_COUNT)).alias("duration"),
            guarded_percent(F.sum("has_date_added_count"), F.sum(_COUNT)).alias("date_added"),
            guarded_percent(F.sum("has_release_year_count"), F.sum(_COUNT)).alias(
                "release_year"
            ),
        )
    )
    labels = {
        "director": "Director",
        "cast": "Cast",
        "duration": "Duration",
        "date_added": "Date Added",
        "release_year": "Release Year",
    }
    return reshape.transpose(tiers, _TIER, labels, "field", TIER_ORDER)


def type_tier_hierarchy(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    """Types and, below them, tiers: titles, and the score weighted by titles."""
    return reshape.hierarchy_totals(
        selected(scorecard, content_types),
        [_TYPE, _TIER],
        [
            F.sum(_COUNT).alias(_COUNT),
            weighted_mean("avg_quality_score", _COUNT, 3).alias("avg_quality_score"),
        ],
    )


def low_quality_rows(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    return rows.keep_matching(selected(scorecard, content_types), _TIER, "Poor|Fair")


def has_low_quality(scorecard: DataFrame, content_types: Types = None) -> bool:
    return not low_quality_rows(scorecard, content_types).isEmpty()


def table(scorecard: DataFrame, content_types: Types = None) -> DataFrame:
    columns = [
        _TYPE, _TIER, _COUNT, "percentage_of_type", "avg_quality_score", "has_director_pct",
        "has_cast_pct",
    ]
    # Display labels.
    labels = ["Type", "Quality Tier", "Count", "Type %", "Avg Score", "Director %", "Cast %"]
    ordered = ranking.order_mixed(
        selected(scorecard, content_types).select(*columns),
        [(_TYPE, True), (_COUNT, False), (_TIER, True)],
    )
    return rows.relabel(ordered, labels)
