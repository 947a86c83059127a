"""CSV with line breaks inside fields, read in splits, and the records that do not fit the schema.

Spark splits a CSV file between tasks only where no field has a line break. Here lines are read in splits,
and the parity of the quotes before a line says whether it starts a record or goes on with one. Each block
counts its own quotes; sums over the blocks before it come from a table of a row for each block. Lines are
then glued to records in the order of the scan, without a shuffle; only the records that reach over the end
of a block are put together from their fragments. ``from_csv`` parses what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratalog.schema import BRONZE_SCHEMA

#: Blocks that open inside a record or end their lines with CR LF; a row of 24 bytes for each is broadcast.
MOST_MARKED_BLOCKS = 1_000_000
WHOLE, FRAGMENT = 0, 1
_RAW = "_raw"
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, block, value``: each line with its file and where the split that has it starts."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _marked_blocks(lines: DataFrame) -> DataFrame:
    """``file, block, open, crlf`` of the blocks where either holds.

    ``open``: an odd number of quotes comes before the block. A file has CR LF if its first line does. A file
    whose quotes do not close fails the query: it is no CSV that can be cut at line ends.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # Lines come in order, so the first one of the first block is the first of its file.
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"), F.first(F.endswith("value", F.lit("\r"))).alias("_cr"))
    in_file = Window.partitionBy("file").orderBy("block")
    whole = Window.partitionBy("file")
    before = F.coalesce(F.sum("quotes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(
        "file", "block", (before % 2 == 1).alias("open"), F.first("_cr").over(in_file).alias("crlf"),
        (F.sum("quotes").over(whole) % 2 == 1).alias("_odd"),
    )
    error = F.raise_error(F.lit("a file has a quote that does not close")).cast("boolean")
    checked = placed.withColumn("open", F.when(F.col("_odd"), error).otherwise(F.col("open")))
    return checked.where("open OR crlf").drop("_odd")


def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``file, block, value, open, crlf`` in order to ``file, block, kind, record``.

    A record that starts or ends in another block comes as fragments, the others whole. The first record of
    a file, its header, is among them: it has block 0 and ``first``.
    """
    place, inside, parts, first = None, False, [], False

    def flush(rows: list, kind: int) -> None:
        nonlocal parts, first
        if parts:
            rows.append((*place, kind, first, "\n".join(parts)))
            first = False
        parts = []

    def table(rows: list) -> pa.RecordBatch:
        files, blocks, kinds, firsts, records = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(files, pa.int64()), pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(records, pa.string())],
            names=["file", "block", "kind", "first", "record"],
        )

    for batch in batches:
        rows: list = []
        odd = (pc.count_substring(batch.column("value"), '"').to_numpy() % 2).astype(bool)
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "value", "open", "crlf")]
        for file, block, value, opened, crlf, flips in zip(*columns, odd.tolist()):
            if (file, block) != place:
                flush(rows, FRAGMENT)  # still inside: it goes on in the next block
                place, inside, first = (file, block), bool(opened), block == 0
                started_here = not inside
            if crlf and value.endswith("\r"):
                value = value[:-1]
            parts.append(value)
            inside ^= flips
            if not inside:
                flush(rows, WHOLE if started_here else FRAGMENT)
                started_here = True
        yield table(rows)
    rows = []
    # The last record of a block is whole unless a quote is open.
    flush(rows, FRAGMENT)
    yield table(rows)


def records(spark: SparkSession, path: str | Sequence[str], header: bool = True) -> DataFrame:
    """``record``: the text of each record; empty lines are left out, and the header of each file.

    A quote inside a field that does not start with one breaks the count; read such files with
    ``multiLine``. Lines end with LF or, throughout a file, with CR LF.
    """
    lines = _lines(spark, path)
    marks = _marked_blocks(lines)
    keys = ["file", "block"]
    if marks.count() <= MOST_MARKED_BLOCKS:  # the join leaves the lines in their order
        marked = lines.join(F.broadcast(marks), keys, "left")
    else:
        numbered = lines.withColumn("_line", F.monotonically_increasing_id())
        marked = numbered.join(marks, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "_line")
    pieces = marked.select(*keys, "value", "open", "crlf").mapInArrow(
        glued, "file bigint, block bigint, kind int, first boolean, record string"
    )
    # The fragments of a record are one that ends its block, any that fill theirs, and one that starts its
    # block: all but the last are the last of their block.
    parts = pieces.where(F.col("kind") == FRAGMENT).withColumn("_n", F.monotonically_increasing_id())
    at = Window.partitionBy("file").orderBy("block", "_n")
    starts = F.coalesce(F.col("open"), F.lit(False))
    opened = parts.join(marks.select(*keys, "open"), keys, "left")
    # A fragment goes on with a record if its block opens inside one and it is the first of its block.
    goes_on = starts & (F.row_number().over(Window.partitionBy(*keys).orderBy("_n")) == 1)
    numbered = opened.withColumn("_record", goes_on).withColumn("_record", F.sum((~F.col("_record")).cast("int")).over(at))
    joined = numbered.groupBy("file", "_record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "_n", "record"))), lambda p: p["record"]), "\n").alias("record"),
        F.max("first").alias("first"),
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "record").unionByName(joined.select("first", "record"))
    kept = whole.where(~F.col("first")) if header else whole
    return kept.select("record").where(F.col("record") != "")


def parsed(records: DataFrame, schema: T.StructType = BRONZE_SCHEMA) -> DataFrame:
    """The columns of ``schema``, ``raw_record`` and ``malformed``.

    ``malformed`` lists what is wrong with a record, and is empty where nothing is: a number of fields other
    than that of the schema, and each field whose text is not of its type. Fields that can be read are.
    """
    fields = [T.StructField(f.name, f.dataType) for f in schema]
    texts = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema), T.StructField(_RAW, T.StringType())])
    typed = T.StructType([*fields, T.StructField(_RAW, T.StringType())])
    both = records.select(
        "record", F.from_csv("record", _ddl(typed), _OPTIONS).alias("_typed"),
        F.from_csv("record", _ddl(texts), _OPTIONS).alias("_text"),
    )

    def wrong(name: str, kind: T.DataType) -> Column:
        text = F.col(f"_text.`{name}`")
        said = F.concat(F.lit(f"{name}: '"), text, F.lit(f"' is not {kind.simpleString()}"))
        return F.when(text.isNotNull() & F.col(f"_typed.`{name}`").isNull(), said)

    number = F.when(F.col(f"_text.{_RAW}").isNotNull(), F.lit(f"not {len(fields)} fields"))
    checks = [wrong(f.name, f.dataType) for f in fields if not isinstance(f.dataType, T.StringType)]
    return both.select(
        *[F.col(f"_typed.`{f.name}`").alias(f.name) for f in fields],
        F.col("record").alias("raw_record"),
        F.array_compact(F.array(number, *checks)).alias("malformed"),
    )


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def read_csv_split(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = BRONZE_SCHEMA) -> DataFrame:
    """What ``read_csv`` gives with ``multi_line``, by as many tasks for a file as it has splits."""
    names = [f.name for f in schema]
    return parsed(records(spark, path), schema).select(*names)


def read_csv_checked(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = BRONZE_SCHEMA, header: bool = True) -> DataFrame:
    """:func:`read_csv_split` with the columns ``raw_record`` and ``malformed`` of :func:`parsed`."""
    return parsed(records(spark, path, header), schema)
