"""Shares, running totals and top-k per group.

Shares and running totals need a whole partition of the window in one task. They are therefore
computed over one row per group: :func:`running_total` aggregates by itself, and
:func:`share_of_group` takes an aggregate, whose size is that of a report and not of the detail.
:func:`accumulate_in_ranges` is for the detail itself: it cuts partitions into ranges of their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.measures import percent
from stratalog.session import scratch_path


def share_of_group(
    groups: DataFrame, partition_by: Sequence[str], value: str, out: str, places: int | None = 2
) -> DataFrame:
    """Percentage that each group's value has in the total of its partition."""
    share = percent(value, F.sum(value).over(Window.partitionBy(*partition_by)))
    return groups.withColumn(out, share if places is None else F.round(share, places))


def accumulate(
    groups: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], value: str, out: str
) -> DataFrame:
    """Running total over rows that are already one per partition and order key."""
    frame = (
        Window.partitionBy(*partition_by)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return groups.withColumn(out, F.sum(value).over(frame))


def running_total(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], value: str, out: str
) -> DataFrame:
    """Sum per partition and order key, then accumulate in order."""
    keys = [*partition_by, *order_by]
    sums = df.groupBy(*keys).agg(F.sum(value).alias(value))
    return accumulate(sums, partition_by, order_by, value, out)


def in_ranges(df: DataFrame, keys: Sequence[str], span: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the number ``span`` of a range of its rows in the order of ``keys``, nulls first.

    Ranges hold about as many rows each, equal keys share one. The borders are drawn from the data and
    would differ in a second run, so the rows are written to the scratch folder, once.
    """
    spark = df.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    df.repartitionByRange(count, *keys).withColumn(span, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def accumulate_in_ranges(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    value: str,
    out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Running total over any number of rows in a partition, which is never in one task.

    Rows are cut into ranges of (partition, order). Each is accumulated alone, and the totals of the
    earlier ranges of its partition are added; of these there is one for each partition in each range.
    ``order_by`` must leave no ties within a partition, and ``value`` be a whole number or a decimal.
    Null values add nothing, and the total is null until the first other value. Null keys are a partition.
    """
    total_type = df.agg(F.sum(value).alias("t")).schema["t"].dataType
    span, before = _free(df, "_range"), _free(df, "_before")
    rows = in_ranges(df, [*partition_by, *order_by], span, ranges)
    cells = rows.groupBy(*partition_by, span).agg(F.sum(value).alias(before))
    earlier = Window.partitionBy(*partition_by).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn(before, F.sum(before).over(earlier).cast(total_type)).where(F.col(before).isNotNull())
    keys = [*partition_by, span]
    named = offsets.toDF(*(f"{c}__" for c in keys), before)
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in partition_by] + [F.col(span) == F.col(f"{span}__")]
    frame = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(value).over(frame)
    # A null is a total of nothing; it must not hide the other part.
    total = F.coalesce(F.col(before) + own, own, F.col(before)).cast(total_type)
    return rows.join(named, same, "left").select(*df.columns, total.alias(out))


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def top_k(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], k: int, rank: str
) -> DataFrame:
    """First k rows of each group, numbered; the order must be total.

    Spark applies the limit before the shuffle too, so a hot group sends k rows per task.
    """
    order = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)
