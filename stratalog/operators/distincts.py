"""Exact numbers of distinct values that roll up: bitmaps of dense ids, stored and merged.

A count of distinct values cannot be added to another. A set of values can: values are numbered from 1
without gaps, and the set of a group is bits at those numbers, in blocks. Blocks of any groups merge with
``bitmap_or_agg``, so one stored table answers for every subset of its keys and every filter on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.windows import accumulate_in_ranges

FIELD, BLOCK, BITS = "field", "block", "bits"


def dense_ids(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """``value, id``: the known values of a column, numbered from 1 in their order.

    Numbers are running totals over ranges of the values; no task has all of them.
    """
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    ones = values.withColumn("_one", F.lit(1).cast("long"))
    return accumulate_in_ranges(ones, [], ["value"], "_one", "id", ranges).drop("_one")


def distinct_states(
    df: DataFrame, keys: Sequence[str], dictionaries: Mapping[str, DataFrame]
) -> DataFrame:
    """``*keys, field, block, bits``: the set of each dictionary's column in each group of ``keys``.

    A group keeps one row for each of its values before it meets the dictionary, so that neither a hot
    group nor a hot value is shuffled. A group without a known value has an empty set. Keys must not be
    called ``field``, ``block`` or ``bits``. A value that its dictionary lacks fails the query.
    """
    return reduce(DataFrame.unionByName, (_states(df, keys, c, d) for c, d in dictionaries.items()))


def _states(df: DataFrame, keys: Sequence[str], column: str, dictionary: DataFrame) -> DataFrame:
    groups = [F.col(k).alias(k) for k in keys]
    pairs = df.select(*groups, F.col(column).alias("_value")).distinct()
    found = pairs.join(dictionary.toDF("_known", "_id"), F.col("_value") == F.col("_known"), "left")
    lost = F.col("_value").isNotNull() & F.col("_id").isNull()
    number = F.when(lost, F.raise_error(F.lit(f"a value of {column} has no number")).cast("long")).otherwise(F.col("_id"))
    numbered = found.select(*keys, number.alias("_id"))
    return numbered.groupBy(*keys, F.bitmap_bucket_number("_id").alias(BLOCK)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias(BITS)
    ).select(*keys, F.lit(column).alias(FIELD), BLOCK, BITS)


def merged_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of fewer keys, or of several tables in one; their dictionaries must be the same."""
    return states.groupBy(*keys, FIELD, BLOCK).agg(F.bitmap_or_agg(BITS).alias(BITS)).select(*keys, FIELD, BLOCK, BITS)


def distinct_counts(states: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The exact number of distinct values of each column in each group of ``keys``, a subset of the stored.

    The columns keep their names; give ``states`` filtered on stored keys for a filtered count.
    """
    counted = merged_states(states, keys).select(*keys, FIELD, F.bitmap_count(BITS).alias("_n"))
    return counted.groupBy(*keys).agg(
        *(F.coalesce(F.sum(F.when(F.col(FIELD) == c, F.col("_n"))), F.lit(0)).alias(c) for c in columns)
    )
