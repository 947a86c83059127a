"""Joins of details with their group totals, with samples, and to top keys.

None carries a broadcast hint: the planner broadcasts a side only where its size, estimated or
measured at run time, is under ``spark.sql.autoBroadcastJoinThreshold``. Beyond that it sorts and
merges, and adaptive execution splits partitions that a hot key has swollen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.ranking import top_n


def with_group_total(df: DataFrame, keys: Sequence[str], value: str, total: str) -> DataFrame:
    """Inner join of every row to the total of its group."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias(total))
    return df.join(totals, list(keys))


def attach(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on all keys; rows without a partner stay."""
    return df.join(extra, list(keys), "left")


def keep_top_groups(
    df: DataFrame, key: str, value: str, n: int, of: DataFrame | None = None
) -> DataFrame:
    """Rows whose key is among the n with the largest sum of ``value`` (ties: smallest key)."""
    totals = (df if of is None else of).groupBy(key).agg(F.sum(value).alias("_total"))
    return df.join(top_n(totals, "_total", n, [key]).select(key), key, "left_semi")
