"""Near duplicates: SuperMinHash signatures, banding, exact verification and union-find grouping.

A document is the set of its distinct five-word shingles, as 64-bit hashes. SuperMinHash gives each
element a random permutation of the signature's places; in step j an element offers the value j + r at
the j-th place of its permutation. A place filled in step j is never improved later, so a document stops
as soon as all its places are filled, most often after one to three steps. As the places of an element
are spread evenly, estimates vary less than with independent minima.

Copies are reduced to one document for each distinct set first. Bands of the signatures bring similar
sets together. The members of a bucket are compared with one of them, and components are formed. Where
buckets still hold several components, their sets make up families, in which all links between different
components are found without pairing the members (see ``families``). All links are settled on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import discard, documents, free_name, give_back, members_first, numbered_rows, ship, without, written
from stratalog.llm.components import components
from stratalog.llm.families import family_links

SHINGLE = 5
BANDS, ROWS = 24, 5  # a pair at 0.85 is missed with probability (1 - 0.85^5)^24, under one in a million
PERCENT = 85
CHUNK_BYTES = 1 << 18  # texts sketched at once; each of their shingles may take a permutation of all places

_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)
_TURNS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=_U,
)  # odd numbers, one for each word of a shingle


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# ------------------------------------------------------------------------------ sets of shingles


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of ``texts`` and the index of its text. Words are hashed eight bytes at a time."""
    joined = b" " + b" ".join(t.translate(_LOWER) for t in texts) + b" " * 9
    data = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=joined, strides=(1,))
    hashes = mix(lengths.astype(_U))
    active, offset = np.arange(len(starts)), 0
    while len(active):
        left = np.minimum(lengths[active] - offset, 8)
        block = eight[starts[active] + offset] & _KEEP[left]
        hashes[active] = mix((hashes[active] ^ block) + _TURNS[0])
        offset += 8
        active = active[lengths[active] > offset]
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(bounds, starts, side="right") - 1


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles, or of its few words as one, or none."""
    words, owner = word_hashes(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = []
    turns = _TURNS[:size]
    combined = np.zeros(max(len(words) - size + 1, 0), dtype=_U)
    for j in range(size):
        combined += words[j : j + len(combined)] * turns[j]
    combined = mix(combined)
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= size:
            sets.append(np.unique(combined[a : b - size + 1]))
        elif b > a:  # its length keeps a short text apart from shingles
            sets.append(mix((words[a:b] * turns[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            sets.append(np.empty(0, dtype=_U))
    return sets


# ---------------------------------------------------------------------------------- SuperMinHash


def super_minhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures (a row of ``places`` values for each set; the row of an empty set means nothing).

    The value j + r is kept as one number: j in the upper half, 32 bits of r in the lower.
    """
    unset = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), places), unset, dtype=_U)
    flat = out.reshape(-1)
    elements = np.concatenate([*sets, np.empty(0, dtype=_U)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order: np.ndarray | None = None  # the permutation of each element, as far as it is drawn
    for step in range(places):
        if step:
            open_sets = (out == unset).any(axis=1)
            going = open_sets[owner]
            if not going.any():
                break
            if not going.all():
                elements, owner = elements[going], owner[going]
                order = None if order is None else order[going]
                first = first[going]
            if order is None:  # only few sets come here; the first step did without
                order = np.tile(np.arange(places, dtype=np.int16), (len(elements), 1))
                rows = np.arange(len(elements))
                order[rows, first] = 0
                order[:, 0] = first
        draw = mix(elements + _U((step + 1) * int(_TURNS[0]) % (1 << 64)))
        target = step + (((draw & _U(0xFFFFFFFF)) * _U(places - step)) >> _U(32)).astype(np.int64)
        if step == 0:
            first = place = target
        else:
            rows = np.arange(len(elements))
            place = order[rows, target]
            order[rows, target] = order[:, step]
            order[:, step] = place
        value = (draw >> _U(32)) | _U(step << 32)
        np.minimum.at(flat, owner * places + place, value)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signatures), bands), dtype=_U)
    for band in range(bands):
        key = np.full(len(signatures), _U(band + 1))
        for row in range(rows):
            key = mix(key * _TURNS[1] + signatures[:, band * rows + row])
        keys[:, band] = key
    return keys


# ------------------------------------------------------------------------------------- workers


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of a batch, a bounded number of bytes at a time."""
    ids, texts, held = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = (text.as_py() or "").encode()
        ids.append(doc)
        texts.append(data)
        held += len(data)
        if held >= CHUNK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _sketch(bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                sets = shingle_sets(texts)
                keys = band_keys(super_minhash(sets, bands * rows), bands, rows).view(np.int64)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(
                            np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))
                        ),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )
        give_back()

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _chunks(batch):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())],
                names=["node", "members"],
            )
    give_back()


def _linked(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("left_set"), batch.column("right_set")):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["low", "high"]).filter(pa.array(keep, pa.bool_()))

    return check


# ------------------------------------------------------------------------------------ operator


def _texts_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows ``doc_id, text`` of distinct nodes. Texts of others are dropped before the shuffle."""
    return members_first(rows, "doc_id", nodes).join(nodes.toDF("node_"), F.col("doc_id") == F.col("node_")).drop("node_")


def verified_links(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs ``low, high`` whose full sets are similar enough, written. ``rows``: doc_id, text."""
    spark = pairs.sparkSession
    pairs, pairs_path = written(pairs, "near-pairs", with_path=True)
    nodes = pairs.select(F.col("low").alias("node")).union(pairs.select("high")).distinct()
    sets, sets_path = written(
        _texts_of(nodes, rows).mapInArrow(_sets, "node bigint, members binary"), "near-sets", with_path=True
    )
    both = pairs.join(sets.toDF("high", "right_set"), "high").join(sets.toDF("low", "left_set"), "low")
    links = written(
        both.select("low", "high", "left_set", "right_set").mapInArrow(_linked(percent), "low bigint, high bigint"),
        "near-links",
    )
    discard(spark, pairs_path, sets_path)
    return links


def links_across(labelled: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links ``low, high`` between components that meet in a bucket.

    ``labelled``: bucket, low (the row all others were compared with), node, n_shingles, part. Buckets that
    hold several components are chained to families by the sets they share.
    """
    counts = labelled.groupBy("bucket").agg(F.min("part").alias("_a"), F.max("part").alias("_b"))
    split = written(counts.where("_a < _b").select("bucket"), "near-split")
    apart, apart_path = written(labelled.join(split, "bucket"), "near-apart", with_path=True)
    chained = components(apart.where("node <> low").select("low", "node").distinct())
    nodes = written(apart.groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("part").alias("part")), "near-nodes")
    sets = _texts_of(nodes.select("node"), rows).mapInArrow(_sets, "node bigint, members binary")
    members = nodes.join(chained.toDF("node", "family"), "node").join(sets, "node")
    members = written(members.select("family", "node", "n", "part", "members"), "near-members")
    discard(rows.sparkSession, apart_path)
    return family_links(members, percent)


def near_groups(
    docs: DataFrame,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows_in_band: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Documents are linked if 100 * intersection >= percent * union of their sets. A null or empty text has
    no shingles and is linked with nothing, not with other empty texts either. Rows that share an id are
    one document: what links one links all. Rows with a null id belong to the class of their equal set;
    they are not named by it and not kept where it has an id. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = written(
        rows.mapInArrow(
            _sketch(bands, rows_in_band),
            "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>",
        ),
        "near-sketches",
    )
    classes = (
        sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    )
    # One row for each distinct set and band.
    first = (F.col("set_key") == F.col("key_")) & (F.col("doc_id") == F.col("node"))
    banded = sketches.join(classes.toDF("key_", "node"), first).select(
        "node", "n_shingles", F.explode("bands").alias("bucket")
    )
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("last"))
    # Written, so that the join starts from two shuffles and a hot bucket can be split there.
    shared, shared_path = written(shared.where("low < last").drop("last"), "near-buckets", with_path=True)
    # Only the rows of buckets with several sets matter from here on.
    crowded, crowded_path = written(banded.join(shared, "bucket"), "near-crowded", with_path=True)
    discard(spark, shared_path)
    star = crowded.where("node > low").select("low", F.col("node").alias("high")).distinct()
    links = verified_links(star, rows, percent)
    parts = written(components(links), "near-parts")
    labelled = crowded.join(parts, "node", "left").select(
        "bucket", "low", "node", "n_shingles", F.coalesce("component", "node").alias("part")
    )
    more = links_across(labelled, rows, percent)
    discard(spark, crowded_path)
    grouped = components(links.union(more))
    named = classes.join(grouped, "node", "left").select(
        F.col("set_key").alias("key_"), F.coalesce("component", "node").alias("component")
    )
    return sketches.join(named, F.col("set_key") == F.col("key_"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, those that are null or repeat coming last.

    Each row is a document of its own here, also one without an id or with that of another row.
    """
    key = free_name(docs, "row_key")
    keyed = numbered_rows(docs, doc_id, key)
    gone = near_groups(keyed, percent, bands, doc_id=key, text=text).where("NOT kept").select("doc_id")
    return without(keyed, key, written(gone, "near-gone")).drop(key)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
