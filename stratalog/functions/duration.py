"""Durations such as ``90 min`` and ``3 Seasons``, and numbers with a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_value(name: str) -> Column:
    """First run of digits as an integer; null where there is none."""
    return F.regexp_extract(F.col(name), r"(\d+)", 1).try_cast("int")


def duration_unit(name: str) -> Column:
    lowered = F.lower(F.col(name))
    return (
        F.when(lowered.contains("min"), F.lit("minutes"))
        .when(lowered.contains("season"), F.lit("seasons"))
        .otherwise(F.lit("unknown"))
    )


def int_or(value: Column, default: int) -> Column:
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(default))
