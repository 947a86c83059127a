"""Alignment of two tokenizers over the same bytes: byte-level BPE (A) and pieces with byte fallback (B).

The character offsets of A and the spans in the immutable protos of B are coarse cuts. They do not tell
where a character is cut that several tokens share, nor which byte a fallback token is; between two cuts the
decoded bytes of the tokens are counted on. So every token has an exact range of bytes, and a text whose
tokens do not give back its bytes has none. Cuts common to both tokenizers make groups. Each stretch between
two neighbouring cuts of either lies in one token of A and one of B: these stretches are the links.

Texts repeat few units (see ``tokens.units``), and neither tokenizer reaches over a safe blank, so a worker
aligns each unit once and adds up what the units of a text have. How often a pair of ids is linked in the
corpus is summed up by task before the shuffle. The sums go to all tasks only below ``MOST_PAIRS``; beyond
that the pairs of the texts are joined with them.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.bpe import byte_letters
from stratalog.llm.common import documents, ship, written
from stratalog.llm.tokens import UnitMemory, units

TOKENS_A, TOKENS_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_PAIRS = 2_000_000  # of 16 bytes: what is sent to all tasks at most
PAIRS_IN_TASK = 500_000  # sums that a task holds before it passes them on
FLUSH_LINKS = 1 << 20
TEXTS_CHARS = 1 << 16  # of texts whose new units are aligned together
SPACE_MARK = "▁"

_COUNTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_ROWS = f"{_COUNTS}, pairs array<bigint>, times array<int>, pair bigint, links bigint"


def _path(name: str) -> str:
    """``name``, or where the installed public tokenizer files have it."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def refined_ends(coarse: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: coarse cuts where the next token starts, decoded bytes counted from there between.

    ``coarse`` and ``starts`` are byte ends and starts of spans of whole characters; a token that ends
    inside a character shares it with the next, whose span then starts before this one's end, or has an
    empty span.
    """
    counted = np.cumsum(lengths)
    if not len(counted):
        return counted
    at_cut = np.append((coarse[:-1] <= starts[1:]) & (starts < coarse)[:-1], True)
    # The last cut before each token, and what the tokens since then are long.
    before = np.concatenate([[-1], np.where(at_cut, np.arange(len(counted)), -1)[:-1]])
    before = np.maximum.accumulate(before)
    base = np.where(before >= 0, coarse[before], 0)
    done = np.where(before >= 0, counted[before], 0)
    return np.where(at_cut, coarse, base + counted - done)


class Aligner:
    """Both tokenizers of a worker, and what it remembers of units."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.length_a, self.length_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{sign}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for sign in ",|;"]
        self.name_lengths = np.array([len(n) for n in self.names], np.int64)
        pre = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        inner = any(SPACE_MARK in self.b.id_to_piece(i).lstrip(SPACE_MARK) for i in range(len(self.bytes_b)))
        # A piece over a blank, or a cutter that is not known to stop there, leaves texts whole.
        self.whole = inner or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)
        self.unit = UnitMemory(self.align)

    def align(self, found: list[str]) -> list[tuple[bytes, bytes, str] | None]:
        """What is linked in the texts ``space + unit``: the numbers of tokens of both kinds and of groups
        (32 bits each), each link as its A id times 2^32 plus its B id (64 bits), and the text of the groups.
        None where tokens do not give back the bytes.

        Units without white space at their ends are put together to one text, as blanks between them are
        safe; if that fails, a unit in it does, and each half is tried for itself.
        """
        together = [] if self.whole else [u for u in found if not (u[0].isspace() or u[-1].isspace() or SPACE_MARK in u)]
        known = dict(zip(together, self._together(together)))
        return [known[u] if u in known else self._together([u])[0] for u in found]

    def _together(self, found: list[str]) -> list[tuple[bytes, bytes, str] | None]:
        values = self._aligned(found) if found else []
        if values is not None:
            return values
        if len(found) == 1:
            return [None]
        half = len(found) // 2
        return self._together(found[:half]) + self._together(found[half:])

    def _aligned(self, found: list[str]) -> list[tuple[bytes, bytes, str]] | None:
        text = " ".join(found)
        encoding = self.a.encode(" " + text, add_special_tokens=False)
        proto = self.b.encode(text, return_type="proto", num_threads=1)
        data, a = (" " + text).encode(), encoding.ids
        b = [(p.id, p.begin, p.end) for p in proto.pieces]
        if not b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i, _, _ in b]):
            return None
        a = np.array(a, np.int64)
        offsets = np.fromiter(chain.from_iterable(encoding.offsets), np.int64).reshape(-1, 2)
        b, begins, ends = np.fromiter(chain.from_iterable(b), np.int64).reshape(-1, 3).T
        if not text.isascii():  # characters to bytes
            leads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            offsets = np.append(leads, len(data))[offsets]
        ends_a = refined_ends(offsets[:, 1], offsets[:, 0], self.length_a[a])
        # Spans of B are in bytes of the text, which lacks the space that B adds.
        ends_b = refined_ends(ends + 1, begins + 1, self.length_b[b])
        sizes = map(len, found if text.isascii() else [u.encode() for u in found])
        unit_ends = np.cumsum(np.fromiter(sizes, np.int64, len(found)) + 1)
        # Both rows of ends rise, so that what they share is found by looking one up in the other.
        last_a = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)] == ends_a
        shared = ends_a[last_a]  # the ends of groups
        group_ends = np.searchsorted(shared, unit_ends, side="right")
        if not (shared[group_ends - 1] == unit_ends).all():
            return None
        of_a, of_b = np.flatnonzero(last_a) + 1, np.searchsorted(ends_b, shared) + 1  # tokens up to each of them
        inside = np.ones(len(b), bool)
        inside[of_b - 1] = False
        cuts = np.sort(np.concatenate([ends_a, ends_b[inside]]), kind="stable")
        links = (a[np.searchsorted(ends_a, cuts)] << 32 | b[np.searchsorted(ends_b, cuts)]).tobytes()
        link_ends = (8 * np.searchsorted(cuts, unit_ends, side="right")).tolist()
        token_ends = [np.searchsorted(e, unit_ends, side="right") for e in (ends_a, ends_b)]
        counts = np.stack([np.diff(e, prepend=0) for e in (*token_ends, group_ends)], axis=1).astype(np.int32).tobytes()
        # Each token with the sign behind it, those of A before those of B in each group.
        signs = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + np.append(0, of_b)[np.cumsum(last_a) - last_a]
        named = 3 * a
        named[of_a - 1] += 1
        signs[place_a] = named
        free = np.ones(len(signs), bool)
        free[place_a] = False
        named = 3 * b
        named[of_b - 1] += 2
        signs[free] = named
        groups = "".join(map(self.names.__getitem__, signs.tolist()))
        name_ends = np.cumsum(self.name_lengths[signs])[token_ends[0] + token_ends[1] - 1].tolist()
        out, link, name = [], 0, 0
        for at, link_end, name_end in zip(range(0, len(counts), 12), link_ends, name_ends):
            out.append((counts[at : at + 12], links[link:link_end], groups[name : name_end - 1]))
            link, name = link_end, name_end
        return out

    def text(self, text: str | None) -> list[tuple[bytes, bytes, str]] | None:
        """The alignments of the units of a text, in order; None if it has no tokens."""
        return self.texts([text])[0]

    def texts(self, texts: list[str | None]) -> list[list[tuple[bytes, bytes, str]] | None]:
        """The same for several texts. What is new in any of them is aligned at once."""
        parts = [[] if not t else [t] if self.whole else units(t) for t in texts]
        found = self.unit(list(chain.from_iterable(parts)))
        ends = list(accumulate(map(len, parts)))
        own = [found[start:end] for start, end in zip([0, *ends], ends)]
        return [None if not f or None in f else f for f in own]


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class _Sums:
    """Numbers of links by pair, merged now and then, so that a task holds a bounded number of them."""

    def __init__(self) -> None:
        self.pairs, self.links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.held = 0

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.links.append(times)
        self.held += len(pairs)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        links = np.zeros(len(pairs), np.int64)
        np.add.at(links, place, np.concatenate(self.links))
        self.pairs, self.links, self.held = [pairs], [links], 0
        return pairs, links


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    """A row for each text with its counts, linked pairs and group hash, and rows of the sums of each task."""
    ship(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(_path(path_a), _path(path_b))
        sums = _Sums()
        names = [c.split()[0] for c in _ROWS.split(", ")]
        kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]

        def table(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def totals(pairs: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
            empty = [None] * len(pairs)
            return table([*[empty] * 8, pairs, links])

        def own_texts(batch: pa.RecordBatch) -> Iterator[tuple]:
            ids, texts, chars = [], [], 0
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                texts.append(whole.as_py())
                chars += len(texts[-1] or "")
                if chars >= TEXTS_CHARS:
                    yield from zip(ids, own.texts(texts))
                    ids, texts, chars = [], [], 0
            yield from zip(ids, own.texts(texts))

        for batch in batches:
            rows, held = [], 0
            for doc, found in own_texts(batch):
                if found is None:
                    rows.append((doc, 0, 0, 0, 0, "", [], [], None, None))
                else:
                    counts, links, groups = zip(*found)
                    counts = np.frombuffer(b"".join(counts), np.int32).reshape(-1, 3).sum(axis=0).tolist()
                    links = np.frombuffer(b"".join(links), np.int64)
                    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
                    pairs, times = np.unique(links, return_counts=True)
                    sums.add(pairs, times)
                    rows.append((doc, *counts, len(links), digest, pairs, times.astype(np.int32), None, None))
                    held += len(pairs)
                if held >= FLUSH_LINKS:
                    yield table(list(zip(*rows)))
                    rows, held = [], 0
                if sums.held >= FLUSH_LINKS:
                    pairs, links = sums.merge()
                    if len(pairs) >= PAIRS_IN_TASK:
                        yield totals(pairs, links)
                        sums = _Sums()
            if rows:
                yield table(list(zip(*rows)))
        pairs, links = sums.merge()
        for at in range(0, len(pairs), 65_536):
            yield totals(pairs[at : at + 65_536], links[at : at + 65_536])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(align, _ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count, best``: links of each pair over all texts, and whether its B id has none with more.

    A pair is the A id times 2^32 plus the B id. No hot pair is left to the shuffle: tasks have summed up.
    Windows hold the pairs of one B id, no more than A has ids.
    """
    summed = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("links").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return summed.withColumn("best", F.col("count") == F.max("count").over(of_b))


def _looked_up(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, often = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            place = np.searchsorted(pairs, listed.flatten().to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            n_best, total = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(n_best, owner, often * best[place])
            np.add.at(total, owner, often * counts[place])
            kept = batch.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n_best), pa.array(total)], names=[*kept.schema.names, "n_best", "count_sum"])

    return look_up


def with_pair_counts(rows: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the rows of texts; ``rows`` is a written table."""
    spark = rows.sparkSession
    texts = rows.where("pair IS NULL")
    counts = written(pair_counts(rows), "pair-counts")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if counts.count() <= most_pairs:
        table = counts.orderBy("pair").toArrow()
        arrays = [np.ascontiguousarray(table.column(c).to_numpy()) for c in ("pair", "count", "best")]
        sent = spark.sparkContext.broadcast(arrays)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _looked_up(*sent.value)(batches)

        found = texts.select(*columns, "pairs", "times").mapInArrow(look_up, f"{_COUNTS}, n_best bigint, count_sum bigint")
    else:
        numbered = written(texts.withColumn("_row", F.monotonically_increasing_id()), "pair-texts")
        listed = numbered.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("time"))))
        summed = (
            listed.join(counts, "pair").groupBy("_row")
            .agg(
                F.sum(F.when(F.col("best"), F.col("time")).otherwise(0)).alias("n_best"),
                F.sum(F.col("time") * F.col("count")).alias("count_sum"),
            )
        )
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
        found = numbered.join(summed, "_row", "left").select(*columns, *zero)
    return found


def aligned(
    docs: DataFrame, path_a: str = TOKENS_A, path_b: str = TOKENS_B, doc_id: str = "doc_id", text: str = "text",
    most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row.

    Special strings are plain text. Null and empty texts, and those whose tokens of either kind do not give
    back a space and the text, have no tokens: zeros and an empty hash. Rows that repeat or have a null id
    are texts of their own, and their links count each time. Other columns are ignored; an empty table
    gives no rows. Texts are tokenised once; their pairs are kept in a scratch table.
    """
    rows = written(aligned_rows(docs, path_a, path_b, doc_id, text), "alignment")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return with_pair_counts(rows, most_pairs).select(*names)


def spans(
    docs: DataFrame, path_a: str = TOKENS_A, path_b: str = TOKENS_B, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, groups``: the groups of each text as ``a1,a2|b1;a3|b2,b3``; null where it has no tokens."""
    ship(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(_path(path_a), _path(path_b))
        for batch in batches:
            for doc, whole in zip(batch.column(0), batch.column(1)):
                found = own.text(whole.as_py())
                groups = None if found is None else ";".join([g for _, _, g in found])
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([groups], pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(align, "doc_id bigint, groups string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))
