"""Packing documents into sequences of fixed length: minimum bin slack over a histogram of lengths.

All pieces of one length are alike, so the problem is as large as the sequence length, not the corpus:
a histogram of at most ``capacity`` counts. For each bin, subset-sum dynamic programming over the lengths
still available finds the fullest feasible combination, and the combination is taken out as often as the
counts allow. What comes of it are patterns: so many sequences with these lengths at these offsets. The
pieces of a length are then ranked on the cluster, and their rank says which sequence and offset is theirs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import documents, give_back, ranked, salt, ship, shuffle_partitions, written
from stratalog.llm.tokens import END_OF_TEXT, word_ids, vocabulary_path

CAPACITY = 2048
FLUSH_ROWS = 4096


# ---------------------------------------------------------------------------- minimum bin slack


def fullest(counts: dict[int, int], capacity: int, seed: int) -> list[int]:
    """The lengths of a fullest bin that holds ``seed``, by a bitset of reachable sums.

    Bit s of the set says that s can be reached. Lengths are added from long to short, each as often as
    it is there, and the set before each addition is kept to walk back. A full bin ends the search.
    """
    room = capacity - seed
    if not room:
        return [seed]
    mask, target = (1 << (room + 1)) - 1, 1 << room
    reached, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[length] - (length == seed), room // length)):
            more = reached | (reached << length) & mask
            if more == reached:
                break
            steps.append((length, reached))
            reached = more
            if reached & target:
                break
        if reached & target:
            break
    total, chosen = reached.bit_length() - 1, [seed]
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> Iterator[tuple[Counter, int]]:
    """Combinations of lengths with how many sequences have them, until no piece is left.

    Each bin starts from the longest piece left, the hardest one to place.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    while left:
        chosen = Counter(fullest(left, capacity, max(left)))
        times = min(left[n] // m for n, m in chosen.items())
        for length, each in chosen.items():
            left[length] -= times * each
            if not left[length]:
                del left[length]
        yield chosen, times


def placements(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first rank, end rank, pieces in a sequence, first sequence, offset`` of each pattern.

    Every pattern uses up a length but for a rest smaller than a sequence takes of it, so there are
    at most capacity * log2(capacity) patterns, however large the corpus.
    """
    rows, sequence, used = [], 0, Counter()
    for chosen, times in patterns(histogram, capacity):
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + times * each, each, sequence, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with ``sequence_id`` and ``offset``.

    Lengths run from 1 to ``capacity``. Only the histogram comes to the driver, and only the
    placements are broadcast; both are bounded by ``capacity``. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [tuple(map(int, r)) for r in placements(histogram, capacity)]
    table = spark.createDataFrame(
        rows, "_length bigint, _first bigint, _end bigint, _each bigint, _sequence bigint, _offset bigint"
    )
    buckets = shuffle_partitions(spark)
    spread = pieces.withColumn("_bucket", salt("doc_id", "piece", "ids_crc32", buckets=buckets))
    order = [F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("ids_crc32")]
    in_length = ranked(spread, ["length"], "_bucket", order, "_rank")
    here = (
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_first"))
        & (F.col("_rank") < F.col("_end"))
    )
    nth = F.col("_rank") - F.col("_first")
    return in_length.join(F.broadcast(table), here).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


# ------------------------------------------------------------------------------------- pieces


def piece_spans(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than the capacity."""
    first = total % capacity or capacity
    return [(0, min(first, total)), *((s, capacity) for s in range(first, total, capacity))]


def tokenised_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of the pieces of each document.

    A document is its ids and one closing id, so null and empty texts are one piece of length one. Rows
    that repeat or have a null id are documents of their own.
    """
    ship(docs.sparkSession)
    closing = np.array([END_OF_TEXT], "<u4").tobytes()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary_path(vocabulary))
        for batch in batches:
            rows: list[list] = [[] for _ in columns]

            def block() -> pa.RecordBatch:
                kinds = [batch.schema[0].type, pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int32())] * with_ids]
                return pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(rows, kinds)], names=columns
                )

            for doc, whole in zip(batch.column(0), batch.column(1)):
                data = ids_of(whole.as_py() or "") + closing
                for number, (start, length) in enumerate(piece_spans(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    values = [doc.as_py(), number, start, length, zlib.crc32(part)]
                    for column, value in zip(rows, values):
                        column.append(value)
                    if with_ids:
                        rows[-1].append(np.frombuffer(part, "<u4").astype(np.int32))
                if len(rows[0]) >= FLUSH_ROWS:
                    yield block()
                    rows = [[] for _ in columns]
            yield block()
        give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(doc_id, text).mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, **columns: str) -> DataFrame:
    """The pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. The pieces are written once, without their ids, so texts are tokenised once."""
    pieces = written(tokenised_pieces(docs, capacity, vocabulary, **columns), "pieces")
    return pack(pieces, capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
