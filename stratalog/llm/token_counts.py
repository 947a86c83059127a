"""Token counts of whole texts: batches of even bytes, long texts in pieces, lengths only.

The library gets each unit of a text, cut where the tokenizer cuts anyway, once as long as a worker remembers it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import documents, ship
from stratalog.llm.tokens import UnitMemory, cut_at_blanks, safe_pieces, tokenizer, units, vocabulary_path

PIECE_CHARS = 65_536
BATCH_BYTES = 1 << 20


def count_tokens(texts: list[str | None], encode_batch, batch_bytes: int, piece_chars: int) -> np.ndarray:
    """Tokens of each text. ``encode_batch`` gets pieces of about ``batch_bytes`` together."""
    counts = np.zeros(len(texts), dtype=np.int64)
    pieces: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        lengths = [len(e) for e in encode_batch(pieces)]
        np.add.at(counts, owners, lengths)
        pieces.clear()
        owners.clear()

    for owner, text in enumerate(texts):
        for piece in safe_pieces(text or "", piece_chars):
            pieces.append(piece)
            owners.append(owner)
            held += len(piece) if piece.isascii() else len(piece.encode())
            if held >= batch_bytes:
                flush()
                held = 0
    if pieces:
        flush()
    return counts


class UnitLengths(dict):
    """Tokens of blank and unit for the units that a worker has met (see ``tokens.units``); this only saves time.

    As in ``tokens.UnitMemory`` there are two bounded generations, and long units are not kept. A unit that is
    not here is noted in ``new`` and counts nothing for now.
    """

    LONGEST, KEPT = UnitMemory.LONGEST, 2 * UnitMemory.KEPT  # numbers take a third of what ids do

    def __init__(self, encode_batch):
        self.encode_batch = encode_batch
        self.older: dict[str, int] = {}
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        tokens = self.older.get(unit)
        if tokens is None:
            self.new.append(unit)
            return 0
        self[unit] = tokens
        return tokens

    def count(self, texts: list[str], batch_bytes: int) -> np.ndarray:
        """Tokens of each text. First units, which follow no blank, and new ones go to the library in batches."""
        counts = np.zeros(len(texts), dtype=np.int64)
        if len(self) >= self.KEPT:
            self.older = dict(self)
            self.clear()
        firsts: list[str] = []
        owners: list[int] = []
        for owner, text in enumerate(texts):
            first, *others = units(text)
            firsts.append(first)
            counts[owner] = sum(map(self.__getitem__, others))
            owners.extend([owner] * (len(self.new) - len(owners)))
        wanted, self.new = self.new, []
        distinct = list(dict.fromkeys(wanted))
        found = self.library(firsts + [" " + unit for unit in distinct], batch_bytes)
        counts += found[: len(firsts)]
        learnt = dict(zip(distinct, found[len(firsts) :].tolist()))
        np.add.at(counts, owners, [learnt[unit] for unit in wanted])
        self.update((unit, tokens) for unit, tokens in learnt.items() if len(unit) <= self.LONGEST)
        return counts

    def library(self, pieces: list[str], batch_bytes: int) -> np.ndarray:
        return count_tokens(pieces, self.encode_batch, batch_bytes, PIECE_CHARS)


@functools.lru_cache(maxsize=2)
def unit_lengths(path: str) -> UnitLengths | None:
    """What a worker remembers for the tokenizer of a file; None if units are not safe for it."""
    if not cut_at_blanks(path):
        return None
    return UnitLengths(functools.partial(tokenizer(path).encode_batch_fast, add_special_tokens=False))


def token_count(
    text: Column, vocabulary: str | None = None, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS
) -> Column:
    """Tokens of a text column as the library gives them; a null text has none."""

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = tokenizer(vocabulary_path(vocabulary))

        def encode(pieces: list[str]):
            return library.encode_batch_fast(pieces, add_special_tokens=False)

        known = unit_lengths(vocabulary_path(vocabulary))

        for batch in batches:
            if known is None:
                yield pa.array(count_tokens(batch.to_pylist(), encode, batch_bytes, piece_chars))
                continue
            counts, texts, held = [np.empty(0, np.int64)], [], 0
            for text in batch:
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= batch_bytes:
                    counts.append(known.count(texts, batch_bytes))
                    texts, held = [], 0
            yield pa.array(np.concatenate([*counts, known.count(texts, batch_bytes)]))

    # The annotations are what tells Spark that this is an iterator function; as text they are not read.
    lengths.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(lengths, "bigint")(text)


def with_token_counts(
    docs: DataFrame,
    limit: int = 1024,
    vocabulary: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row.

    Null texts count as empty: no bytes, no tokens. Nothing is shuffled; rows that repeat or have a
    null id are counted like any other. Other columns are ignored.
    """
    ship(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        token_count(whole, vocabulary).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(documents(spark, sf_dir))


SQL: dict[str, str] = {}
