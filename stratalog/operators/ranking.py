"""Sorting, global top-n and custom order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.quality import tier_position


def _keys(ties: Sequence[str]):
    return [F.col(t).asc_nulls_last() for t in ties]


def top_n(df: DataFrame, measure: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n rows with the largest measure; ``ties`` must make the order total.

    Spark keeps n rows per task and merges those; nothing is sorted as a whole.
    """
    return df.orderBy(F.col(measure).desc_nulls_last(), *_keys(ties)).limit(n)


def order_desc(df: DataFrame, measure: str, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), *_keys(ties))


def order_mixed(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Order by several (column, ascending) keys."""
    return df.orderBy(*(F.col(c).asc() if up else F.col(c).desc() for c, up in keys))


def order_custom(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    return df.orderBy(tier_position(column, order), F.col(column))
