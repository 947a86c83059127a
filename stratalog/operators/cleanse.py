"""Validation, deduplication and the run's quality report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.text import all_present, default_if_blank, default_if_empty


def valid_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.filter(all_present(required))


def rejected_rows(
    df: DataFrame, required: Sequence[str], reason: str, rejected_at: Column
) -> DataFrame:
    """The complement of :func:`valid_rows`: one filter, so identical rejects are all kept."""
    return df.filter(~all_present(required)).withColumns(
        {"rejection_reason": F.lit(reason), "rejected_at": rejected_at}
    )


def split_records(
    df: DataFrame, required: Sequence[str], reason: str, rejected_at: Column
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with all their reasons, of records parsed with ``malformed``.

    Every row is in one of the two. A record that does not fit the schema is rejected for each of its
    faults; ``reason`` is one more where a required value is missing. The raw record stays with a reject.
    """
    present = all_present(required)
    fits = F.size("malformed") == 0
    valid = df.filter(fits & present).drop("malformed", "raw_record")
    reasons = F.array_compact(F.concat("malformed", F.array(F.when(~present, F.lit(reason)))))
    rejected = df.filter(~(fits & present)).withColumns(
        {"rejection_reason": F.array_join(reasons, "; "), "rejected_at": rejected_at}
    )
    return valid, rejected.drop("malformed")


def dedupe(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column] = (), total: bool = False
) -> DataFrame:
    """One row per key: the first by ``order_by``, ties broken by a fingerprint of the row.

    The same row wins however the input is partitioned. With ``total`` the caller says that the order
    leaves no ties; then only the columns in use are read. Spark puts a group limit of one row per key
    in front of the shuffle, so a key with very many copies sends one row per input task.
    """
    ties = [] if total else [F.xxhash64(*(F.col(c) for c in df.columns))]
    first = Window.partitionBy(*keys).orderBy(*order_by, *ties)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def standardise_blanks(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: default_if_blank(c, d) for c, d in defaults.items()})


def fill_empty(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: default_if_empty(c, d) for c, d in defaults.items()})


def quality_report(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """One row of input, output, rejected and duplicate counts and the success rate, in one pass."""
    valid = all_present(required)
    counts = df.agg(
        F.count(F.lit(1)).alias("initial_count"),
        F.count_if(valid).alias("valid_count"),
        F.count_distinct(F.when(valid, F.col(key))).alias("final_count"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    success = F.try_divide(F.col("final_count").cast("double"), F.col("initial_count")) * 100
    return counts.select(
        "initial_count",
        "final_count",
        (F.col("initial_count") - F.col("valid_count")).alias("rejected_count"),
        (F.col("valid_count") - F.col("final_count")).alias("duplicates_removed"),
        F.coalesce(success, F.lit(0.0)).alias("success_rate"),
    )
