"""Exact duplicates: counting quotient filters find repeated fingerprints, bytes settle them.

1. One scan writes a slim table: id, length, 64-bit fingerprint and SHA-256 of the normalised text.
2. Each partition of it builds counting quotient filters, one for each block of fingerprints. A filter
   keeps the quotient of a fingerprint by place (an occupied bit and a run end) and stores only the
   remainder, in sorted runs, with a counter where it was seen more than once.
3. The filters of a block are merged by their sorted remainders. Quotient and remainder are the whole
   fingerprint, so nothing is lost. A hot fingerprint reaches the merge once per partition.
4. Only rows whose fingerprint has a count above one go on. Their texts are compared byte by byte: they
   are grouped by the text itself, after a map-side combine, so equal fingerprints of unlike texts do
   no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import (
    WHITE_SPACE,
    apart,
    documents,
    free_name,
    members_first,
    ship,
    shuffle_partitions,
    whole_row,
    without,
    written,
)

FILTER_SCHEMA = (
    "block int, quotient_bits int, slots int, occupied binary, run_ends binary, remainders binary,"
    " counted binary, counters binary"
)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


# ------------------------------------------------------------------- counting quotient filter


def encode_filter(fingerprints: np.ndarray, counts: np.ndarray, block_bits: int) -> dict:
    """A filter of sorted distinct uint64 fingerprints that share their first ``block_bits`` bits."""
    slots = len(fingerprints)
    quotient_bits = max(int(slots - 1).bit_length(), 1)
    remainder_bits = 64 - block_bits - quotient_bits
    local = fingerprints & np.uint64((1 << (64 - block_bits)) - 1)
    quotients = (local >> np.uint64(remainder_bits)).astype(np.int64)
    remainders = local & np.uint64((1 << remainder_bits) - 1)
    occupied = np.zeros(1 << quotient_bits, dtype=bool)
    occupied[quotients] = True
    run_ends = np.append(quotients[1:] != quotients[:-1], True)
    width = -(-remainder_bits // 8)
    counted = counts > 1
    return {
        "block": int(fingerprints[0] >> np.uint64(64 - block_bits)) if block_bits else 0,
        "quotient_bits": quotient_bits,
        "slots": slots,
        "occupied": np.packbits(occupied).tobytes(),
        "run_ends": np.packbits(run_ends).tobytes(),
        "remainders": remainders.astype("<u8").view(np.uint8).reshape(slots, 8)[:, :width].tobytes(),
        "counted": np.packbits(counted).tobytes(),
        "counters": counts[counted].astype("<u8").tobytes(),
    }


def decode_filter(row: dict, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    slots, quotient_bits = row["slots"], row["quotient_bits"]
    remainder_bits = 64 - block_bits - quotient_bits
    width = -(-remainder_bits // 8)

    def bits(name: str, size: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(row[name], dtype=np.uint8), count=size).astype(bool)

    ends = np.flatnonzero(bits("run_ends", slots))
    quotients = np.flatnonzero(bits("occupied", 1 << quotient_bits))
    runs = np.diff(np.append(-1, ends))
    wide = np.zeros((slots, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(row["remainders"], dtype=np.uint8).reshape(slots, width)
    prints = wide.reshape(-1).view("<u8") | (
        np.repeat(quotients, runs).astype(np.uint64) << np.uint64(remainder_bits)
    )
    if block_bits:
        prints |= np.uint64(row["block"]) << np.uint64(64 - block_bits)
    counts = np.ones(slots, dtype=np.uint64)
    counts[bits("counted", slots)] = np.frombuffer(row["counters"], dtype="<u8")
    return prints, counts


def merge_sorted(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the counts of equal fingerprints, in order. A stable sort merges sorted runs."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[starts], np.add.reduceat(counts, starts)


def _filters_of_partition(block_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_counts = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(new):
                kept, kept_counts = merge_sorted(
                    np.concatenate([kept, new]),
                    np.concatenate([kept_counts, np.ones(len(new), np.uint64)]),
                )
        if not len(kept):
            return
        blocks = kept >> np.uint64(64 - block_bits) if block_bits else np.zeros_like(kept)
        cuts = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(kept))
        rows = [encode_filter(kept[a:b], kept_counts[a:b], block_bits) for a, b in zip(cuts, cuts[1:])]
        schema = pa.schema([
            ("block", pa.int32()), ("quotient_bits", pa.int32()), ("slots", pa.int32()),
            *[(n, pa.binary()) for n in ("occupied", "run_ends", "remainders", "counted", "counters")],
        ])
        for start in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_pylist(rows[start : start + 1024], schema=schema)

    return build


def _merge_block(block_bits: int):
    def merge(table: pa.Table) -> pa.Table:
        parts = [decode_filter(row, block_bits) for row in table.to_pylist()]
        prints, counts = merge_sorted(*(np.concatenate(x) for x in zip(*parts)))
        above = counts > 1
        return pa.table({
            "fingerprint": prints[above].view(np.int64), "copies": counts[above].astype(np.int64)
        })

    return merge


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """``fingerprint, copies`` of the values of a bigint column that occur more than once.

    The number of blocks follows the shuffle partitions, which follow the input; the result does not
    depend on it. A merge holds the distinct fingerprints of one block, 8 bytes each, and its filters.
    """
    spark = prints.sparkSession
    ship(spark)
    block_bits = min(math.ceil(math.log2(max(shuffle_partitions(spark), 1))) + 1, 30)
    filters = prints.toDF("fingerprint").mapInArrow(_filters_of_partition(block_bits), FILTER_SCHEMA)
    return filters.groupBy("block").applyInArrow(
        _merge_block(block_bits), "fingerprint bigint, copies bigint"
    )


# ------------------------------------------------------------------------------------ operator


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Of equal texts (white space aside) the one with the most code points in its original text stays,
    then the smallest id. Null texts count as empty, and all empty texts form one group. Rows that
    repeat an id with an equal text are copies of each other, and all of them carry the kept id. Null
    ids come after all others. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    plain = normalised(F.col("text"))
    slim = written(
        rows.select("doc_id", plain.alias("plain")).select(
            "doc_id",
            F.xxhash64("plain").alias("fingerprint"),
            F.sha2(F.encode("plain", "UTF-8"), 256).alias("text_sha256"),
        ),
        "exact-slim",
    )
    repeated = written(repeated_fingerprints(slim.select("fingerprint")), "exact-repeated").select(
        "fingerprint"
    )
    single = slim.join(repeated, "fingerprint", "left_anti").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    suspects = slim.join(repeated, "fingerprint", "left_semi").select("doc_id")
    claimed = (
        members_first(rows, "doc_id", suspects)
        .select("doc_id", plain.alias("plain"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
        .withColumn("fingerprint", F.xxhash64("plain"))
        .join(repeated, "fingerprint")  # as these are distinct; a semi-join would move ahead of the filter
    )
    # Bits turned over reverse the order of ids; a minus would overflow at the least one.
    backwards = F.bitwise_not(F.col("doc_id")).alias("backwards")
    best = F.max(F.struct("chars", F.col("doc_id").isNotNull().alias("known"), backwards))
    # Written, so that the join below starts from two shuffles and a hot text can be split there.
    groups = written(
        claimed.groupBy("plain").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "exact-groups"
    )
    verified = claimed.select("doc_id", "plain").join(groups, "plain").select(
        "doc_id",
        F.bitwise_not(F.col("best.backwards")).alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.bitwise_not(F.col("best.backwards"))).alias("kept"),
        F.sha2(F.encode("plain", "UTF-8"), 256).alias("text_sha256"),
    )
    return single.unionByName(verified)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; a repeated row stays once for each repeat."""
    gone = written(exact_groups(docs, doc_id, text).where("NOT kept").select("doc_id"), "exact-gone")
    return without(docs, doc_id, gone)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts, whatever the ids are.

    The row is chosen as in ``exact_groups``; of rows that agree in id and length, by a hash of all columns.
    Only rows that may have a copy are shuffled, and of a hot text one row from each task.
    """
    name, place, whole = (free_name(docs, n) for n in ("fingerprint", "_place", "_whole"))
    plain = normalised(F.col(text))
    prints = docs.withColumn(name, F.xxhash64(plain))
    repeated = written(repeated_fingerprints(prints.select(name)), "exact-repeated").select("fingerprint")
    single, claimed = apart(prints, name, repeated)
    claimed = claimed.withColumn(whole, whole_row(docs))
    best = Window.partitionBy(plain).orderBy(
        F.length(F.coalesce(F.col(text), F.lit(""))).desc(), F.col(doc_id).asc_nulls_last(), whole
    )
    first = claimed.withColumn(place, F.row_number().over(best)).where(F.col(place) == 1)
    return single.select(*docs.columns).union(first.select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
), g AS (
  SELECT doc_id, plain, count(*) OVER (PARTITION BY plain) AS group_size,
    first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g"""
}
