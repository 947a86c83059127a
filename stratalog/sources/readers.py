"""CSV and Parquet scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratalog.functions.text import null_tokens_to_null
from stratalog.schema import BRONZE_SCHEMA


def _csv(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = BRONZE_SCHEMA,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header and a given schema; doubled quotes inside quoted fields are one quote.

    Line breaks inside fields need ``multi_line``, and then one task reads one file. Where the data
    has none, turn it off and Spark splits large files.
    """
    return _csv(spark, multi_line).schema(schema).csv(path)


def read_csv_inferred(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool = True,
    null_tokens: Sequence[str] = (),
) -> DataFrame:
    """CSV whose types are inferred, at the cost of a pass over the data.

    ``null_tokens`` turns texts such as ``n/a`` into null in the text columns.
    """
    df = _csv(spark, multi_line).option("inferSchema", True).csv(path)
    if not null_tokens:
        return df
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_tokens_to_null(c, null_tokens) for c in texts})


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet; ``column=value`` folders become columns, and filters on them skip folders."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))
