"""Pivot, unpivot, hierarchy totals and transposed matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_sum(
    df: DataFrame,
    rows: Sequence[str],
    column: str,
    value: str,
    column_values: Sequence | None = None,
) -> DataFrame:
    """Sum of ``value`` per row key and column value, 0 where a cell has no row.

    Without ``column_values`` Spark looks up the distinct ones first, which costs a job. With them a
    value outside the list fails the query, so nothing is left out unseen.
    """
    if column_values is None:
        return df.groupBy(*rows).pivot(column).agg(F.sum(value)).na.fill(0)
    listed = list(column_values)
    checked = df.withColumn(column, _listed(column, listed))
    return checked.groupBy(*rows).pivot(column, listed).agg(F.sum(value)).na.fill(0)


def _listed(name: str, values: Sequence) -> Column:
    """The column, or an error where it has a value (not null) that is not listed."""
    unknown = F.col(name).isNotNull() & ~F.col(name).isin(list(values))
    message = F.concat(F.lit(f"{name} has a value that is not listed: "), F.col(name).cast("string"))
    return F.when(unknown, F.raise_error(message)).otherwise(F.col(name))


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str,
    value: str,
    strip_prefix: str = "",
) -> DataFrame:
    """Wide to long; the prefix is cut from the names."""
    long = df.unpivot(list(ids), list(columns), name, value)
    if strip_prefix:
        long = long.withColumn(name, F.replace(F.col(name), F.lit(strip_prefix), F.lit("")))
    return long


def hierarchy_totals(
    df: DataFrame, levels: Sequence[str], measures: Sequence[Column], grand_total: bool = False
) -> DataFrame:
    """Totals at every level of a hierarchy; ``depth`` counts the keys that are set.

    The rollup repeats each input row once per level, so give it rows that are aggregated already.
    """
    totals = df.rollup(*levels).agg(*measures, F.grouping_id().alias("_gid"))
    # A rollup sets the last bits of the grouping id first: n low bits stand for n dropped keys.
    depth = F.lit(len(levels)) - F.bit_count("_gid")
    totals = totals.withColumn("depth", depth.cast("int")).drop("_gid")
    return totals if grand_total else totals.filter(F.col("depth") > 0)


def transpose(
    df: DataFrame, key: str, fields: dict[str, str], field: str, key_values: Sequence[str]
) -> DataFrame:
    """One row per field and one column per key; ``fields`` maps columns to row labels.

    A key that is not listed fails the query.
    """
    labelled = df.select(_listed(key, key_values).alias(key), *(F.col(c).alias(label) for c, label in fields.items()))
    long = labelled.unpivot([key], list(fields.values()), field, "_value")
    # One row per field and key, so any aggregate hands the value through.
    return long.groupBy(field).pivot(key, list(key_values)).agg(F.max("_value"))


def to_rows(df: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Each input row becomes one row per entry, e.g. a row of figures a table of metrics."""
    structs = [F.struct(*(c.alias(n) for n, c in row.items())) for row in rows]
    return df.select(F.inline(F.array(*structs)))
