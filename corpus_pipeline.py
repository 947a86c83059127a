"""From raw documents to packed sequences: the stages in order, each on what the one before it kept.

Every stage is written as Parquet to the shared scratch folder and read again, so a lost executor costs
no more than the stage it was working on. A stage that filters returns the columns of documents; the last
one returns the pieces of the documents that are left, with their places in sequences. The classifiers are
fitted on what reaches their stage and on the ``labels`` of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import exact_dedup, minhash, packing, quality, toxicity
from stratalog.llm.common import documents, written
from stratalog.sources.derived import load

NEAR_PERCENT = 80  # similarity of five-word shingles from which a document is a near copy; op5 has a bar of its own
NEAR_BANDS = 36  # a pair at 0.80 is missed with probability (1 - 0.8^5)^36, under one in a million


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, load(spark, sf_dir, "labels")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality.drop_poor(docs, quality.fit_quality(docs, load(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays."""
    return minhash.drop_near_copies(docs, NEAR_PERCENT, NEAR_BANDS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", clean_language),
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("packing", sequences),
]

# Fitted models, signatures and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
