"""Parquet and CSV sinks; all overwrite, so a repeated run gives the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_partitioned(df: DataFrame, path: str, partition_column: str = "content_type") -> None:
    """One folder per value. Rows are not shuffled by it, so a frequent value stays spread out."""
    (
        df.write.partitionBy(partition_column)
        .mode("overwrite")
        .option("compression", "snappy")
        .parquet(path)
    )


def overwrite_partitions(df: DataFrame, path: str, partition_column: str = "content_type") -> None:
    """Replace the folders of the values that ``df`` has; all others are left as they are.

    Spark writes to a staging folder and moves it when all tasks are done. The rows may come from other
    folders of the same table, not from those replaced.
    """
    (
        df.write.partitionBy(partition_column)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .parquet(path)
    )


def write_bucketed(
    df: DataFrame, database: str, name: str, path: str, keys: Sequence[str], buckets: int
) -> None:
    """A table of ``buckets`` sorted files by the hash of ``keys``: joins, windows and groups on them need no shuffle.

    The rows are shuffled here, once. A hot key is one bucket, so take keys that are about unique.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .mode("overwrite")
        .option("path", path)
        .option("compression", "snappy")
        .format("parquet")
        .saveAsTable(f"`{database}`.`{name}`")
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_single_file(df: DataFrame, path: str) -> None:
    """One file, for tables of a fixed few rows only: a single task writes it."""
    write_parquet(df.coalesce(1), path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write only a table that has rows, else remove what is there; looks for one row, does not count."""
    if df.isEmpty():
        remove(df.sparkSession, path)
        return False
    write_parquet(df, path)
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, if there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def render_arrays(df: DataFrame) -> DataFrame:
    """Arrays as texts of the form ``[a, b]``; a null array stays null."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]

    def text(name: str):
        joined = F.array_join(F.col(name).cast("array<string>"), ", ")
        return F.concat(F.lit("["), joined, F.lit("]"))

    return df.withColumns({c: text(c) for c in arrays}) if arrays else df


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; texts are kept as they are, arrays are rendered."""
    (
        render_arrays(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
