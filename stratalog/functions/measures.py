"""Aggregate expressions whose result does not depend on the order of the rows.

Adding doubles in another order can flip a rounded digit, and a cluster never adds twice in the same
order. Scores and rounded measures are multiples of a known step, so these sum whole steps and
divide once. A value that is no multiple of its step fails the query instead of being rounded. Sums of
steps are decimals of 30 digits, which no table overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def steps(value: str | Column, places: int) -> Column:
    """A value with at most ``places`` decimals, as a whole number of its last place."""
    return _whole(_col(value) * F.lit(float(10**places)), f"more than {places} decimals")


def _whole(scaled: Column, fault: str) -> Column:
    """The whole number behind a double that is one but for its rounding error."""
    whole = F.round(scaled)
    off = F.abs(scaled - whole) > F.greatest(F.lit(1e-6), F.abs(whole) * 1e-12)
    message = F.concat(F.lit(f"a value has {fault}: "), scaled.cast("string"))
    return F.when(off, F.raise_error(message).cast("long")).otherwise(whole.cast("long"))


def wide_sum(whole: str | Column) -> Column:
    """Sum of whole numbers beyond the range of a bigint."""
    return F.sum(_col(whole).cast("decimal(20,0)"))


def exact_sum(value: str | Column, places: int) -> Column:
    return wide_sum(steps(value, places)).cast("double") / F.lit(float(10**places))


def exact_mean(value: str | Column, places: int) -> Column:
    """Mean of the non-null values; null where there is none."""
    return F.try_divide(
        wide_sum(steps(value, places)).cast("double"),
        F.count(_col(value)) * F.lit(float(10**places)),
    )


def weighted_mean(value: str | Column, weight: str, places: int) -> Column:
    """Mean over the non-null values, each counted ``weight`` times."""
    known_weight = F.when(_col(value).isNotNull(), F.col(weight))
    return F.try_divide(
        F.sum(steps(value, places).cast("decimal(19,0)") * F.col(weight)).cast("double"),
        F.sum(known_weight) * F.lit(float(10**places)),
    )


def score_points(score: str | Column, points: int) -> Column:
    """The whole points behind a score that is ``k / points``; another score is an error."""
    return _whole(_col(score) * F.lit(float(points)), f"no whole number of {points} points")


def mean_score(score: str | Column, points: int) -> Column:
    return F.try_divide(
        F.sum(score_points(score, points)).cast("double"),
        F.count(_col(score)) * F.lit(float(points)),
    )


def count_where(condition: Column) -> Column:
    """Number of rows that meet the condition: 0 without a match, null without any row."""
    return F.sum(F.when(condition, 1).otherwise(0))


def share_where(condition: Column) -> Column:
    """Percentage of the rows that meet the condition."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def percent(part: str | Column, whole: str | Column) -> Column:
    return F.try_divide(_col(part) * F.lit(100.0), _col(whole))


def guarded_percent(part: str | Column, whole: str | Column) -> Column:
    """Percentage that is 0, not null, where the whole is 0 or missing."""
    ratio = F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))
    return F.coalesce(ratio * 100, F.lit(0.0))
