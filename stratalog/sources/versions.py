"""Tables that readers can use while they are replaced: each write has a folder of its own.

A name in the catalogue is a view of one folder. A new version is written beside it, and only when all of
it is there is the view switched, by one change in the catalogue. A write that fails leaves the old version
as it was. Older folders stay for readers that began with them, until :func:`forget` removes them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from stratalog.sources import sinks

VERSION = "version-"


def new_version(root: str) -> str:
    """The folder of a version; names of later ones come after those of earlier ones."""
    return f"{root.rstrip('/')}/{VERSION}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish(df: DataFrame, database: str, name: str, root: str, partition_column: str | None = None) -> str:
    """Write a new version of a table below ``root`` and make it the one that ``name`` reads; its folder."""

    def write(folder: str) -> dict[str, str]:
        if partition_column:
            sinks.write_partitioned(df, folder, partition_column)
        else:
            sinks.write_parquet(df, folder)
        return {name: folder}

    return publish_bundle(df.sparkSession, database, root, write)


def publish_bundle(
    spark: SparkSession, database: str, root: str, write: Callable[[str], Mapping[str, str]]
) -> str:
    """Tables that belong together: ``write`` fills a new folder and tells the path of each name.

    No name is switched before all are written. Names are then switched one after another.
    """
    folder = new_version(root)
    try:
        tables = write(folder)
    except BaseException:
        sinks.remove(spark, folder)
        raise
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, path in tables.items():
        switch(spark, database, name, path)
    return folder


def switch(spark: SparkSession, database: str, name: str, path: str) -> None:
    """Make ``name`` a view of the Parquet folder ``path``, in one step."""
    location = path.replace("`", "``")
    spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS SELECT * FROM parquet.`{location}`")


def versions(spark: SparkSession, root: str) -> list[str]:
    """The folders below ``root``, oldest first."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(base):
        return []
    names = [status.getPath().getName() for status in system.listStatus(base)]
    return sorted(f"{root.rstrip('/')}/{n}" for n in names if n.startswith(VERSION))


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all versions but the latest ``keep``, one at least; the folders removed.

    Call it when no query runs that began before the last but ``keep`` - 1 writes, and no write is under way.
    """
    gone = versions(spark, root)[: -max(keep, 1)]
    for folder in gone:
        sinks.remove(spark, folder)
    return gone
