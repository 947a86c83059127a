"""Completeness flags, score, tiers and rating categories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_known(name: str, sentinel: str) -> Column:
    return F.col(name) != sentinel


def is_recent(age: str, max_age: int) -> Column:
    return F.coalesce(F.col(age) <= max_age, F.lit(False))


def completeness_score(flags: Sequence[Column], points: int) -> Column:
    """Share of the flags that hold, between 0 and 1."""
    return reduce(lambda a, b: a + b, (f.cast("int") for f in flags)) / F.lit(float(points))


def tier(score: str, tiers: Sequence[tuple[str, float]], lowest: str) -> Column:
    """Label of the first cut point that the score reaches; null falls to the lowest tier."""
    chain = F
    for label, cut in tiers:
        chain = chain.when(F.col(score) >= cut, F.lit(label))
    return chain.otherwise(F.lit(lowest))


def tier_position(name: str, order: Sequence[str]) -> Column:
    """1-based position of a label in a custom order, for sorting; unknown labels come last."""
    position = F.array_position(F.array(*(F.lit(t) for t in order)), F.col(name))
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1))


def category(
    name: str, categories: Sequence[tuple[str, Sequence[str]]], other: str
) -> Column:
    chain = F
    for label, members in categories:
        chain = chain.when(F.col(name).isin(*members), F.lit(label))
    return chain.otherwise(F.lit(other))


def producer_type(genre_count: str) -> Column:
    # Labels and bounds of the three groups.
    return (
        F.when(F.col(genre_count) <= 2, F.lit("Specialist (1-2)"))
        .when(F.col(genre_count) <= 4, F.lit("Moderate (3-4)"))
        .otherwise(F.lit("Generalist (5+)"))
    )
