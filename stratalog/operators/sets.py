"""Differences of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks, without repeats.

    Both sides lose their copies before the join, so a row repeated very often is shuffled once
    per task and not in full.
    """
    return left.distinct().subtract(right.distinct())


def difference_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag difference: each row of ``right`` takes away one equal row of ``left``."""
    return left.exceptAll(right.toDF(*left.columns))
