"""Token ids in binary files: blocks of bit or byte planes, each compressed, with a chunk index.

An id of 32 bits rarely uses its upper bits, and neighbours differ in their lower ones. A block of ids is
therefore transposed: all first bytes (or bits) together, then all second ones and so on. Each plane is
compressed with zstandard; planes without content shrink to a few bytes.

A table is a folder of files, one for each task, in the order of their part numbers. Spark's text sink
writes and commits them, which works on every file system Spark knows and survives repeated tasks; all it
adds is one byte behind each record. A file holds, in this order:

* a record of compressed planes for each block of ``block`` ids (the last one may be shorter),
* a record of the documents: ids (a 64-bit number each), which of them are null, and token counts,
* the chunk index, as JSON: part number, plane kind, ids in all, place and length of the documents'
  columns, and for each block its first id, how many it has, and place and length of each plane,
* a record of 16 bytes: place and length of the chunk index.

So any span of ids is read by its blocks alone, and any file without the others.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.window import Window

from stratalog.llm.common import documents, ship, written
from stratalog.llm.tokens import word_ids, vocabulary_path
from stratalog.session import scratch_path

BLOCK = 65_536
END_OF_DOCUMENT = 2
LEVEL = 3
_FLUSH_ROWS = 8192


# ------------------------------------------------------------------------------------- planes


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of unsigned 32-bit ids, lowest first."""
    if kind == "byte":
        return [plane.tobytes() for plane in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    if kind == "bit":
        return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(32)]
    raise ValueError(f"planes are of bytes or bits, not {kind}")


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
        return np.ascontiguousarray(rows).view("<u4").reshape(-1)
    out = np.zeros(count, np.uint32)
    for b, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count).astype(np.uint32) << np.uint32(b)
    return out


@functools.lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


# -------------------------------------------------------------------------------------- files


class PlaneWriter:
    """Turns documents into the records of one file; it holds one block and a few numbers a document."""

    def __init__(self, part: int, kind: str, block: int):
        self.part, self.kind, self.block = part, kind, block
        self.held: list[np.ndarray] = []
        self.waiting = self.total = self.place = 0
        self.blocks: list[dict] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def _record(self, columns: list[bytes]) -> tuple[bytes, list[list[int]]]:
        """The columns compressed and joined, and the place and length of each in the file."""
        packed = [_zstd()[0].compress(c) for c in columns]
        places = []
        for data in packed:
            places.append([self.place, len(data)])
            self.place += len(data)
        self.place += 1  # what the sink adds
        return b"".join(packed), places

    def _block(self, ids: np.ndarray) -> bytes:
        record, places = self._record(to_planes(ids, self.kind))
        self.blocks.append({"first": self.total, "count": len(ids), "planes": places})
        self.total += len(ids)
        return record

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ready = np.concatenate(self.held)
            whole = len(ready) // self.block * self.block
            for start in range(0, whole, self.block):
                yield self._block(ready[start : start + self.block])
            self.held, self.waiting = [ready[whole:]], len(ready) - whole

    def finish(self) -> Iterator[bytes]:
        if self.waiting:
            yield self._block(np.concatenate(self.held))
        known = np.array([d is not None for d in self.docs], bool)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        record, places = self._record([ids.tobytes(), np.packbits(known).tobytes(), np.array(self.counts, "<i8").tobytes()])
        yield record
        index = json.dumps(
            {"part": self.part, "kind": self.kind, "ids": self.total, "docs": len(self.docs), "documents": places, "blocks": self.blocks}
        ).encode()
        yield index
        yield np.array([self.place, len(index)], "<i8").tobytes()


class PlaneFile:
    """A file of planes in memory or mapped: spans of ids are read from their blocks alone."""

    def __init__(self, data):
        self.data = memoryview(data)
        place, length = np.frombuffer(self.data[-17:-1], "<i8")
        self.index = json.loads(bytes(self.data[place : place + length]))

    def _column(self, span: list[int]) -> bytes:
        return _zstd()[1].decompress(self.data[span[0] : span[0] + span[1]])

    def block(self, number: int) -> np.ndarray:
        block = self.index["blocks"][number]
        return from_planes([self._column(p) for p in block["planes"]], block["count"], self.index["kind"])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of this file."""
        parts = []
        for number, block in enumerate(self.index["blocks"]):
            first, count = block["first"], block["count"]
            if first < end and start < first + count:
                parts.append(self.block(number)[max(start - first, 0) : end - first])
        return np.concatenate([*parts, np.empty(0, np.uint32)])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Id and token count of each document, in order."""
        ids, known, counts = map(self._column, self.index["documents"])
        ids = np.frombuffer(ids, "<i8")
        known = np.unpackbits(np.frombuffer(known, np.uint8), count=len(ids)).astype(bool)
        return [int(i) if k else None for i, k in zip(ids, known)], np.frombuffer(counts, "<i8")

    def each_document(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first token and ids of each document; one block and one document are held at a time."""
        docs, counts = self.documents()
        held, number, start = np.empty(0, np.uint32), 0, 0
        for doc, count in zip(docs, counts.tolist()):
            parts, have = [held], len(held)
            while have < count:
                parts.append(self.block(number))
                have += len(parts[-1])
                number += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, start, held[:count]
            held, start = held[count:], start + count


# ----------------------------------------------------------------------------------- operators


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` in ascending order over all partitions, null ids last.

    Rows of one id are in the order of a hash of their texts. Where these are equal too, the rows cannot be
    told apart by what is written; a number keeps such a group from being one task's.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_number": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie"), F.col("_number")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int | None = END_OF_DOCUMENT,
    kind: str = "byte",
    block: int = BLOCK,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """The ids of all documents in ascending order of their ids, as files in a new folder ``path``.

    A null or empty text has its end id alone (nothing, without one). Rows that share an id are documents of
    their own; null ids come last. Texts are tokenised once, after the shuffle by ranges of ids.
    """
    ship(docs.sparkSession)
    closing = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary_path(vocabulary))
        writer = PlaneWriter(TaskContext.get().partitionId(), kind, block)
        records: list[bytes] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

        for batch in batches:
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(ids_of(whole.as_py() or "") + closing, "<u4")
                records.extend(writer.add(doc, ids))
                if len(records) >= 16:
                    yield batch_of()
                    records.clear()
        if writer.docs:
            records.extend(writer.finish())
        yield batch_of()

    encoded = in_order(docs, doc_id, text).mapInArrow(encode, "record binary")
    # The sink writes the bytes of a string as they are.
    encoded.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    kind = T.StructType([T.StructField("content", T.BinaryType())])
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select(*kind.names)


def read_documents(
    spark: SparkSession, path: str, value: Callable[[np.ndarray], object], name: str, kind: pa.DataType
) -> DataFrame:
    """``doc_id, start, n_tokens`` of each document of a written folder, and ``value`` of its ids.

    ``start`` is the number of ids of all documents before it. Files are read whole, one in a task; sums
    over earlier files come from a table of a row for each file.
    """
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(part: int, rows: list[tuple]) -> pa.RecordBatch:
            docs, starts, counts, values = zip(*rows)
            kinds = [pa.int64()] * 4 + [kind]
            columns = [[part] * len(rows), docs, starts, counts, values]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "doc_id", "start", "n_tokens", name])

        for batch in batches:
            for content in batch.column(0):
                file = PlaneFile(content.as_buffer())
                rows = []
                for doc, start, ids in file.each_document():
                    rows.append((doc, start, len(ids), value(ids)))
                    if len(rows) == _FLUSH_ROWS:
                        yield batch_of(file.index["part"], rows)
                        rows = []
                if rows:
                    yield batch_of(file.index["part"], rows)

    schema = f"part bigint, doc_id bigint, start bigint, n_tokens bigint, {name} {from_arrow_type(kind).simpleString()}"
    found = written(_files(spark, path).mapInArrow(decode, schema), "planes-read")
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    earlier = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    joined = found.join(earlier, F.col("part") == F.col("_part"))
    return joined.select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", name)


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-planes")
    write_ids(documents(spark, sf_dir), path)
    return read_documents(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", pa.int64())
