"""What the operators share: shipping the code to workers, scratch tables, ranks without hot groups."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.session import scratch_path
from stratalog.sources.derived import load

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Largest filter of ``members_first``: 2^30 bits, 128 MiB, whatever the input.
MAX_FILTER_BITS = 1 << 30
#: Bytes of the rows that a worker gets at once, and Spark's default, with which both sides hold 10,000 texts or 64 MB.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
BATCH_UNSET = "67108864b"
_BITMAP_BITS = 32_768  # what one value of bitmap_construct_agg holds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Batches of rows for them get a lower bound in bytes, in a session that is at Spark's default.
    """
    if spark.conf.get(BATCH_SETTING) == BATCH_UNSET:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    marker = "_stratalog_shipped"
    if getattr(context, marker, False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="stratalog-code-")) / "stratalog_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    context.addPyFile(os.fspath(archive))
    setattr(context, marker, True)


def give_back() -> None:
    """Memory that the allocators of a worker keep for later goes back to the system.

    Workers live as long as their executor and hold what their largest task needed; each task gives it back.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of the C library of Linux only
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, name: str, with_path: bool = False):
    """``df`` written to the shared scratch folder and read again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return (table, path) if with_path else table


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables of this run that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _bitmaps(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, Column, Column]:
    """A bit array of the hashes of ``keys`` in blocks, the condition that joins them to the rows of ``df``,
    and whether a row's bit is set.

    It has about 16 bits for each key and ``MAX_FILTER_BITS`` at most, which is the proven bound of what is
    broadcast; beyond it more rows are taken for members, never fewer. Null keys are treated as a value.
    """
    bits = min(MAX_FILTER_BITS, max(_BITMAP_BITS, 1 << math.ceil(math.log2(16 * keys.count() + 1))))
    place = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(bits))
    member = keys.select(F.col(keys.columns[0]).alias(key)).select(place.alias("_place"))
    bitmaps = member.groupBy(F.floor(F.col("_place") / _BITMAP_BITS).alias("_block")).agg(
        F.bitmap_construct_agg(F.col("_place") % _BITMAP_BITS).alias("_bitmap")
    )
    bitmaps = bitmaps.toDF(free_name(df, "_block"), free_name(df, "_bitmap"))
    block, bitmap = (F.col(c) for c in bitmaps.columns)
    at = (place % _BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.broadcast(bitmaps), F.floor(place / _BITMAP_BITS) == block, F.getbit(byte.cast("int"), at % 8) == 1


def members_first(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the one column of ``keys``, before a join settles it.

    Rows of wide text are dropped here, ahead of the shuffle of that join. It must not be a semi-join, which
    Spark would move ahead of this filter.
    """
    bitmaps, same_block, hit = _bitmaps(df, key, keys)
    return df.join(bitmaps, same_block).where(hit).select(*[df[c] for c in df.columns])


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the one column of ``keys``; null keys stay.

    Only rows that may be in it are shuffled for the exact answer; all others pass as they are.
    """
    bitmaps, same_block, hit = _bitmaps(df, key, keys)
    name, mark = free_name(df, "gone_id"), free_name(df, "_hit")
    marked = df.join(bitmaps, same_block, "left").withColumn(mark, F.coalesce(hit, F.lit(False)))
    columns = [df[c] for c in df.columns]
    gone = keys.select(F.col(keys.columns[0]).alias(name)).distinct()
    unsure = marked.where(F.col(mark)).select(*columns)
    # Not an anti-join, which Spark would move ahead of the filter.
    settled = unsure.join(gone, F.col(key) == F.col(name), "left").where(F.col(name).isNull()).drop(name)
    return marked.where(~F.col(mark)).select(*columns).union(settled)


def apart(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` is not in the one column of ``keys``, and those whose key may be.

    Null keys are a value like any other. Nothing is shuffled.
    """
    bitmaps, same_block, hit = _bitmaps(df, key, keys)
    mark = free_name(df, "_hit")
    marked = df.join(bitmaps, same_block, "left").withColumn(mark, F.coalesce(hit, F.lit(False)))
    columns = [df[c] for c in df.columns]
    return marked.where(~F.col(mark)).select(*columns), marked.where(F.col(mark)).select(*columns)


def whole_row(df: DataFrame) -> Column:
    """A hash of all columns, by which rows are put in order that nothing else tells apart."""
    return F.sha2(F.to_json(F.struct(*df.columns)).cast("binary"), 256)


def numbered_rows(df: DataFrame, doc_id: str, key: str) -> DataFrame:
    """``df`` with a bigint ``key`` that no two rows share and none lacks.

    It is in the order of the ids where these are known and unique. Rows whose id is null or repeats, and
    only they, are written and numbered beyond all ids, rows without an id last; the same rows get the same
    numbers in every run. Ids that leave no such numbers among the values of a bigint are refused.
    """
    spark = df.sparkSession
    known = F.col(doc_id).cast("long")
    repeated = df.select(known.alias("id")).groupBy("id").count().where("id IS NULL OR count > 1")
    repeated = written(repeated.select("id"), "rows-repeated-ids")
    keyed = df.withColumn(key, known)
    if repeated.isEmpty():
        return keyed
    sure, unsure = apart(keyed, key, repeated)
    name = free_name(keyed, "repeated_id")
    settled = unsure.join(repeated.toDF(name), F.col(key).eqNullSafe(F.col(name)), "left")
    other = F.col(key).isNotNull() & F.col(name).isNull()
    group, bucket, row, rank = (free_name(keyed, n) for n in ("_all", "_salt", "_row", "_rank"))
    many = shuffle_partitions(spark)
    extra = settled.where(~other).select(*df.columns)
    extra = extra.withColumn(row, whole_row(extra)).withColumn(group, F.lit(0))
    extra = extra.withColumn(bucket, salt(row, buckets=many) + F.when(F.col(doc_id).isNull(), many).otherwise(0))
    extra = written(ranked(extra, [group], bucket, [F.col(row)], rank), "rows-numbered")
    most, low, high = df.agg(F.count(F.lit(1)), F.min(known), F.max(known)).first()
    low, high = (0, -1) if low is None else (low, high)
    down = 0 if high + most < 1 << 63 else most
    if low - down < -(1 << 63):
        raise ValueError("the ids leave no numbers for rows whose id is null or repeats")
    own = sure.union(settled.where(other).select(*keyed.columns)).withColumn(key, F.col(key) - F.lit(down))
    return own.union(extra.select(*df.columns, (F.lit(high - down + 1) + F.col(rank)).alias(key)))


def salt(*columns: str | Column, buckets: int) -> Column:
    """Even bucket of a row by the hash of some of its columns."""
    return F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(buckets))


def ranked(df: DataFrame, within: list[str], bucket: str, order: list[Column], rank: str) -> DataFrame:
    """``df`` with the exact rank (from 0) of each row within ``within``, ordered by bucket, then ``order``.

    A group is never sorted in one task: rows are numbered in each (group, bucket), and the sums of
    the counts of earlier buckets, a small table, are added. A bucket is to hold an even share of the
    rows of its group, so the caller takes it from a hash or from an evenly spread value. Groups and
    buckets must not be null.
    """
    cells = df.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("_cell"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *[F.col(c).alias(f"_{c}") for c in [*within, bucket]],
        F.coalesce(F.sum("_cell").over(before), F.lit(0)).alias("_before"),
    )
    numbered = df.withColumn(
        "_number", F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order))
    )
    joined = numbered.join(offsets, on=[F.col(c) == F.col(f"_{c}") for c in [*within, bucket]])
    return joined.select(
        *df.columns, (F.col("_before") + F.col("_number") - 1).cast("long").alias(rank)
    )
