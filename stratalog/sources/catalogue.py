"""Tables by name: registration, full reads, ad-hoc SQL and the bundle of gold tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from stratalog.plans.gold import GOLD_TABLES


def register_views(tables: Mapping[str, DataFrame], prefix: str = "") -> None:
    """Temporary views, for SQL in this session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def register_table(
    spark: SparkSession, database: str, name: str, path: str, partitioned: bool = False
) -> None:
    """A catalogue table over Parquet files in place; partition folders are picked up."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    table = f"`{database}`.`{name}`"
    location = path.replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{location}'")
    if partitioned:
        repair_partitions(spark, database, name)


def repair_partitions(spark: SparkSession, database: str, name: str) -> None:
    """Make partition folders written since the registration visible."""
    spark.sql(f"MSCK REPAIR TABLE `{database}`.`{name}`")


def read_table(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(f"`{database}`.`{name}`")


def query(spark: SparkSession, sql: str, database: str | None = None) -> DataFrame:
    """Run SQL, with unqualified names resolved in ``database``; errors are raised."""
    if database is None:
        return spark.sql(sql)
    previous = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(database)
    try:
        return spark.sql(sql)
    finally:
        spark.catalog.setCurrentDatabase(previous)


def load_gold(
    spark: SparkSession, database: str, names: Iterable[str] = GOLD_TABLES
) -> dict[str, DataFrame]:
    """Gold tables by name, all or some; nothing is read before an action."""
    return {name: read_table(spark, database, name) for name in names}
