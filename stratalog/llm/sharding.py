"""Shards that all have the mixture of the whole: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. Sorted by their fractional rank, the
sources interleave in proportion to their sizes, so any cut of that order has the mixture of the whole.
It is cut so that shards differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import documents, ranked, shuffle_partitions

SHARDS = 40
ROW_BYTES = 16


def interleaved(
    docs: DataFrame, shards: int = SHARDS, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """``doc_id, source, size, text_crc32, law, shard, slot, grown_shard`` for each row.

    The law is ``rows``; ``grown_shard`` is null, as it belongs to another law. Null sources form one
    source, null texts have no bytes. Equal texts are spread like any rows: a group may be larger than
    a shard. Rows that repeat an id get slots of their own. Only ids, sizes and ranks are shuffled. A
    source of one row has a place of its own, so many such sources do not meet in one place. With fewer rows than shards the last shards stay empty.
    """
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
    ).select(
        "*",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_group"),
        F.col("source").isNull().alias("_none"),
        # 32 bits decide the shuffle, the id what they leave open.
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 32).alias("_draw"),
    )
    rows = rows.withColumn("_part", F.floor(F.col("_draw") * buckets / F.lit(float(1 << 32))).cast("int"))
    order = [F.col("_draw"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32")]
    in_source = ranked(rows, ["_group", "_none"], "_part", order, "_rank")
    # Sources start at places of their own, evenly spread over one step of their ranks.
    sizes = (
        rows.groupBy(F.col("_group").alias("_g"), F.col("_none").alias("_n"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_lot", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "_g", "_n"), 32))
        .withColumn("_bin", F.floor(F.col("_lot") * buckets / F.lit(float(1 << 32))).cast("int"))
        .withColumn("_one", F.lit(0))
    )
    sources = sizes.groupBy().agg(F.count(F.lit(1)).alias("_sources"))
    starts = ranked(sizes, ["_one"], "_bin", [F.col("_lot"), F.col("_g"), F.col("_n")], "_start").join(
        F.broadcast(sources)  # one row
    )
    placed = (
        in_source.join(starts, (F.col("_group") == F.col("_g")) & (F.col("_none") == F.col("_n")))
        .withColumn("_fraction", (F.col("_rank") + (F.col("_start") + 0.5) / F.col("_sources")) / F.col("_size"))
        .withColumn("_all", F.lit(0))
        .withColumn("_range", F.floor(F.col("_fraction") * buckets).cast("int"))
        .select(*[c for c in in_source.columns if c not in ("_draw", "_part")], "_fraction", "_all", "_range")
    )
    place = [F.col("_fraction"), F.col("_group"), F.col("_none"), F.col("_rank")]
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("_total"))
    base, extra = F.floor(F.col("_total") / shards), F.col("_total") % shards
    longer = extra * (base + 1)  # rows in the shards that hold one more
    early = F.col("_row") < longer
    shard = F.when(early, F.floor(F.col("_row") / (base + 1))).otherwise(
        extra + F.floor((F.col("_row") - longer) / F.greatest(base, F.lit(1)))
    )
    slot = F.when(early, F.col("_row") % (base + 1)).otherwise((F.col("_row") - longer) % F.greatest(base, F.lit(1)))
    return (
        ranked(placed, ["_all"], "_range", place, "_row")
        .join(F.broadcast(total))  # one row
        .select(
            "doc_id", "source", "size", "text_crc32",
            F.lit("rows").alias("law"),
            shard.cast("int").alias("shard"),
            slot.cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved(documents(spark, sf_dir))


SQL: dict[str, str] = {}
