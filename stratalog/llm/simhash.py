"""SimHash fingerprints of documents, and the search for all fingerprints within a Hamming radius.

Only DataFrame functions: terms are exploded, and each adds its weight to the bits that its hash sets.
A term is a word with its successor, so that frequent words alone make no two texts alike. A bit of the
fingerprint is set if more than half of the weight voted for it.

The search cuts fingerprints into radius + 1 blocks. Two fingerprints within the radius agree in at least
one whole block, so one table for each block, keyed by that block, finds all candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import documents, shuffle_partitions, written

BITS = 128
RADIUS = 3
HEAVIEST = 16
_SPACES = r"[\x20\x09-\x0D]+"
_LANES = 0x0000000100000001  # bits i and i + 32 of a hash are counted in the two halves of one number


# ------------------------------------------------------------------------------- fingerprints


def _voted(first: str, total: Column) -> Column:
    """The 64 bits of the counters ``first``0 to ``first``31."""
    bits = F.lit(0).cast("long")
    for i in range(32):
        counter = F.col(f"{first}{i}")
        for bit, votes in ((i, counter.bitwiseAND(0xFFFFFFFF)), (i + 32, F.shiftrightunsigned(counter, 32))):
            bits = bits.bitwiseOR(F.when(2 * votes > total, F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(0))
    return bits


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, high, low``: the two halves of the fingerprint of each distinct value of ``keys``.

    The weight of a term is the length of its words, ``HEAVIEST`` at most: short words say little. A text
    without words has one empty term. Counters hold 2^27 terms. Partial sums of a text meet by its key,
    so a very long text needs no more memory than a short one once its words are streamed.
    """
    words = F.split(F.col(text), _SPACES)
    pairs = texts.select(
        *keys, F.inline(F.arrays_zip(words.alias("word"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("next")))
    ).toDF(*keys, "word", "next")
    hashed = pairs.select(
        *keys,
        F.least(F.length("word") + F.coalesce(F.length("next"), F.lit(0)), F.lit(HEAVIEST)).cast("long").alias("_w"),
        F.xxhash64("word", "next").alias("_h"),
        F.xxhash64(F.lit(1), "next", "word").alias("_l"),
    )
    lanes = F.lit(_LANES)
    summed = hashed.groupBy(*keys).agg(
        F.sum("_w").alias("_total"),
        *[
            F.sum(F.col("_w") * F.shiftrightunsigned(F.col(h), i).bitwiseAND(lanes)).alias(f"{h}{i}")
            for h in ("_h", "_l")
            for i in range(32)
        ],
    )
    total = F.col("_total")
    return summed.select(*keys, _voted("_h", total).alias("high"), _voted("_l", total).alias("low"))


def printed(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return 1.0 - distance(a, b) / F.lit(float(BITS))


# ------------------------------------------------------------------------------------- search


def blocks(high: Column, low: Column, count: int) -> list[Column]:
    """``count`` parts of the 128 bits, each a whole number of bits and within one half or over the border."""
    edges = [BITS * i // count for i in range(count + 1)]
    parts = []
    for a, b in zip(edges, edges[1:]):
        cut = []
        for word, base in ((low, 0), (high, 64)):
            start, end = max(a, base) - base, min(b, base + 64) - base
            if start < end:
                width = end - start
                shifted = F.shiftrightunsigned(word, start)
                cut.append(shifted if width == 64 else shifted.bitwiseAND((1 << width) - 1))
        parts.append(F.xxhash64(*cut) if len(cut) > 1 else cut[0])
    return parts


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``query, query_low, high, low, distance``: each query fingerprint with all those within ``radius``.

    Both tables have ``high, low``; each is reduced to its distinct fingerprints first, so copies cost
    nothing, and results refer to fingerprints, not to documents. A pair is given by the first block in
    which it agrees, so it comes once. The equal fingerprint is found at distance 0. Blocks have
    128 / (radius + 1) bits; a block shared by many fingerprints is a large join key, which adaptive
    execution splits.
    """
    if not 0 <= radius < BITS:
        raise ValueError(f"a radius is from 0 to {BITS - 1}")

    def tables(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        distinct = df.select(F.col("high").alias(names[0]), F.col("low").alias(names[1])).distinct()
        cut = F.array(*blocks(F.col(names[0]), F.col(names[1]), radius + 1))
        return distinct.select(*names, F.posexplode(cut).alias("table", "block"))

    asked, all_ = tables(queries, ("query_high", "query_low")), tables(prints, ("high", "low"))
    joined = asked.join(all_, ["table", "block"])
    asked_for, found = (F.col("query_high"), F.col("query_low")), (F.col("high"), F.col("low"))
    first = F.lit(radius + 1)
    for number, (a, b) in reversed(list(enumerate(zip(blocks(*asked_for, radius + 1), blocks(*found, radius + 1))))):
        first = F.when(a == b, number).otherwise(first)
    return joined.where((distance(asked_for, found) <= radius) & (F.col("table") == first)).select(
        "query_high", "query_low", "high", "low", distance(asked_for, found).alias("distance")
    )


# -------------------------------------------------------------------------- the registered query


def following(ids: DataFrame, key: str) -> DataFrame:
    """``key, next``: each distinct id with the next smaller one; the smallest is followed by the largest.

    Ids are dealt into ranges by a sample and written, so a range is the same for whoever reads it. A
    window runs in each range, and the last id of each range, one row for each, closes the gaps.
    """
    spark = ids.sparkSession
    parts = 2 * shuffle_partitions(spark)
    dealt = written(
        ids.select(key).distinct().repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()),
        "ids-in-ranges",
    )
    inside = Window.partitionBy("_part").orderBy(key)
    ends = dealt.groupBy("_part").agg(F.max(key).alias("_most"))
    over = Window.partitionBy(F.lit(0)).orderBy("_part")
    whole = Window.partitionBy(F.lit(0))
    ends = ends.select(
        F.col("_part").alias("_range"),
        F.coalesce(F.lag("_most").over(over), F.max("_most").over(whole)).alias("_before"),
    )
    return (
        dealt.withColumn("_lag", F.lag(key).over(inside))
        .join(F.broadcast(ends), F.col("_part") == F.col("_range"))  # a row for each range
        .select(key, F.coalesce("_lag", "_before").alias("next"))
    )


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS, every: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of the texts and of edited texts, and how alike they are.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_near``. The edited text has its last third replaced by the start of the next document in descending
    order of ids. ``n_near`` counts the documents whose fingerprint is within ``radius``, the document
    itself included; it is given for ids divisible by ``every`` and null for the others.

    Null texts count as empty. Rows equal in id and text give one row. Of different texts under one id the
    smallest follows the id before it. Rows with a null id are left out, as they have no place in the
    order. A single document is followed by itself.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(
        "doc_id IS NOT NULL"
    )
    taken = F.floor(F.length("text") / 3).cast("int")
    sizes = written(rows.select("doc_id", taken.alias("taken")), "thirds")
    order = written(following(sizes, "doc_id"), "next-ids")
    serves = (
        order.join(sizes.groupBy("doc_id").agg(F.max("taken").alias("taken")), "doc_id")
        .select(F.col("next").alias("doc_id"), F.col("doc_id").alias("to"), "taken")
    )
    starts = (
        rows.join(serves, "doc_id")
        .select(F.col("to").alias("doc_id"), F.expr("substring(text, 1, taken)").alias("start"))
        .groupBy("doc_id")
        .agg(F.min("start").alias("start"))
    )
    edited = F.concat(
        F.expr("substring(text, 1, n_chars - taken)"), F.expr("substring(start, 1, taken)")
    )
    texts = (
        rows.join(starts, "doc_id")
        .select("doc_id", "text", "start", F.length("text").alias("n_chars"), taken.alias("taken"))
        .select("doc_id", "n_chars", "text", edited.alias("edited"))
        .select(
            "doc_id",
            F.col("n_chars").cast("long").alias("n_chars"),
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            F.xxhash64("text").alias("_own"),
            F.posexplode(F.array("text", "edited")).alias("_kind", "_text"),
        )
    )
    keys = ["doc_id", "n_chars", "edited_sha256", "_own", "_kind"]
    prints = fingerprints(texts, keys, "_text")

    def of(kind: int, half: str) -> Column:
        return F.max(F.when(F.col("_kind") == kind, F.col(half)))

    both = written(
        prints.groupBy(*keys[:4]).agg(
            of(0, "high").alias("high"), of(0, "low").alias("low"),
            of(1, "high").alias("edited_high"), of(1, "low").alias("edited_low"),
        ),
        "fingerprints",
    )
    nexts = (
        both.groupBy("doc_id").agg(F.min(F.struct("_own", "high", "low")).alias("_n"))
        .select(F.col("doc_id").alias("next"), F.col("_n.high").alias("next_high"), F.col("_n.low").alias("next_low"))
    )
    asked = both.where(F.col("doc_id") % every == 0)
    classes = both.groupBy("high", "low").agg(F.count(F.lit(1)).alias("size"))
    near = (
        within_radius(asked, both, radius)
        .join(classes, ["high", "low"])
        .groupBy("query_high", "query_low")
        .agg(F.sum("size").alias("n_near"))
    )
    own, other = (F.col("high"), F.col("low")), (F.col("edited_high"), F.col("edited_low"))
    return (
        both.join(order, "doc_id").join(nexts, "next")
        .join(near, (F.col("high") == F.col("query_high")) & (F.col("low") == F.col("query_low")), "left")
        .select(
            "doc_id", "n_chars", "edited_sha256",
            printed(*own).alias("fingerprint"),
            printed(*other).alias("edited_fingerprint"),
            likeness(own, other).alias("near_edited"),
            likeness(own, (F.col("next_high"), F.col("next_low"))).alias("near_next"),
            F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"),
        )
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
