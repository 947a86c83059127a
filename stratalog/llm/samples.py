"""Folds, and samples whose expected size is bounded, by hashes of ids: the same rows in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def thinned(df: DataFrame, doc_id: str, expected: int, seed: int) -> DataFrame:
    """About ``expected`` rows of ``df``, or all if it has fewer: those whose id hashes low enough."""
    size = df.count()
    if size <= expected:
        return df
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 32)
    return df.where(draw < int(expected / size * (1 << 32)))


def known_labels(labels: DataFrame, column: str, expected: int, seed: int) -> DataFrame:
    """``doc_id, label`` of about ``expected`` labelled rows outside the held-out fold.

    Ids with labels 0 and 1, and null or other labels, teach nothing and are left out.
    """
    usable = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where("label IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
    )
    return thinned(usable.select("doc_id", "label"), "doc_id", expected, seed)
