"""Aggregate expressions and small aggregate plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_where(
    df: DataFrame, by: Sequence[str], key: str, conditions: dict[str, Column]
) -> DataFrame:
    """Exact numbers of distinct keys per group among the rows that meet each condition.

    Each key of a group shrinks to one row of flags first, with a map-side combine. Several distinct
    counts at once would repeat every input row for each of them.
    """
    flags = [F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    keys = df.groupBy(*by, key).agg(*flags)
    known = F.col(key).isNotNull()
    return keys.groupBy(*by).agg(*(F.count_if(known & F.col(n)).alias(n) for n in conditions))


def arg_max(key: str, measure: str) -> Column:
    """Key of the largest measure; the smallest key wins a tie."""
    return F.min_by(F.col(key), F.struct(-F.col(measure), F.col(key)))


def row_of_max(columns: Sequence[str], measure: str, ties: Sequence[str]) -> Column:
    """The columns of the row with the largest measure, as a struct; ``ties`` make it unique."""
    return F.min_by(
        F.struct(*columns), F.struct(-F.col(measure), *(F.col(t) for t in ties))
    )


def sorted_set(name: str) -> Column:
    return F.sort_array(F.collect_set(name))


def list_in_order(value: str, position: str) -> Column:
    """Values of a group in the order of their position; only for groups of bounded size."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position), F.col(value))))
    return pairs.getField(value)


def first_known(name: str) -> Column:
    """The value of a column that the group key determines; the smallest where it does not."""
    return F.min(name)


def group_totals(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))


def count_rows(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def having_at_least(df: DataFrame, measure: str, minimum: int) -> DataFrame:
    return df.filter(F.col(measure) >= minimum)


def mean_of_group_sums(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum per group, then the plain mean of those sums."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    return sums.agg(F.avg("_sum").alias(out))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()
