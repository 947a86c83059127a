"""Projections, renames and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import all_not_null, all_present


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def relabel(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """New names by position, e.g. for display."""
    return df.toDF(*labels)


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def keep_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows where none of the columns is null or blank."""
    return df.filter(all_present(columns))


def keep_not_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.filter(all_not_null(columns))


def exclude_value(df: DataFrame, column: str, sentinel: str) -> DataFrame:
    """Drop the sentinel, and null with it."""
    return df.filter(F.col(column) != sentinel)


def exclude_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(~F.col(column).contains(text))


def keep_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def keep_in(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows whose value is listed; ``None`` selects everything."""
    return df if values is None else df.filter(F.col(column).isin(*values))


def keep_between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Closed range; an open end is ``None``."""
    bounds = []
    if low is not None:
        bounds.append(F.col(column) >= low)
    if high is not None:
        bounds.append(F.col(column) <= high)
    return df.filter(reduce(lambda a, b: a & b, bounds)) if bounds else df


def with_literals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})
