"""Centroid clustering on dictionaries of subvectors.

Components are turned into integers once. Blocks of dimensions are then dictionary-encoded without loss:
a chunk of vectors keeps the distinct subvectors of each block and a code for each vector. A round computes
the exact distance of every distinct subvector to the centroids' part of that block once, and the distance
of a vector is the sum of these by its codes. All arithmetic is on whole numbers, so results do not
depend on partitioning, and ties go to the smaller number.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import free_name, ship, written
from stratalog.sources.derived import load

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
BLOCK = 2  # dimensions of a dictionary
CHUNK = 4096  # vectors that share dictionaries
#: Largest component: with 64 dimensions all distances still fit 64 bits.
LARGEST = 1 << 27

_ENCODED = "ids array<bigint>, codes binary, entries binary, sizes array<int>"


def whole_vectors(vectors: DataFrame, dimensions: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, vector``: vectors of that length without null or non-finite components, in integers.

    A component is floor(scale * x) with x as double; one beyond ``LARGEST`` fails the query, as distances
    would not fit.
    """
    x, infinite = F.col(embedding), F.lit(float("inf"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < infinite), F.lit(False)))
    kept = vectors.where((F.size(x) == dimensions) & finite)
    step = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)))
    fits = F.forall("vector", lambda v: (v >= -LARGEST) & (v <= LARGEST))
    checked = F.when(fits, F.col("vector")).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("array<bigint>")
    )
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), step.alias("vector")).withColumn("vector", checked)


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order.

    Rows without an id come last. Rows of one id have one hash; their components decide between them.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(clusters)
    return np.array([r.vector for r in rows.collect()], np.int64)


# ------------------------------------------------------------------------------- dictionaries


def encode_blocks(vectors: np.ndarray, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A code for each vector and block, and the distinct subvectors of each block."""
    codes, entries = [], []
    for start in range(0, vectors.shape[1], block):
        distinct, code = np.unique(vectors[:, start : start + block], axis=0, return_inverse=True)
        entries.append(distinct)
        codes.append(code.reshape(-1).astype(np.uint16))
    return np.stack(codes), entries


def distances(codes: np.ndarray, entries: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """The exact squared distance of each vector to each centroid."""
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    start = 0
    for code, distinct in zip(codes, entries):
        part = centroids[:, start : start + distinct.shape[1]]
        partial = ((distinct[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)
        total += partial[code]
        start += distinct.shape[1]
    return total


def _encoder(dimensions: int, block: int, chunk: int):
    if chunk > 1 << 16:
        raise ValueError("codes have 16 bits")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                codes, entries = encode_blocks(vectors, block)
                whole = b"".join(e.astype("<i4").tobytes() for e in entries)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()),
                        pa.array([whole], pa.binary()), pa.array([[len(e) for e in entries]], pa.list_(pa.int32())),
                    ],
                    names=["ids", "codes", "entries", "sizes"],
                )

    return encode


def _chunks(batches: Iterator[pa.RecordBatch], dimensions: int, block: int) -> Iterator[tuple]:
    """Ids, codes and dictionaries of each chunk."""
    widths = [min(block, dimensions - s) for s in range(0, dimensions, block)]
    for batch in batches:
        for ids, codes, entries, sizes in zip(*batch.columns):
            flat, distinct, start = np.frombuffer(entries.as_buffer(), "<i4").astype(np.int64), [], 0
            for size, width in zip(sizes.as_py(), widths):
                distinct.append(flat[start : start + size * width].reshape(size, width))
                start += size * width
            yield ids.values, np.frombuffer(codes.as_buffer(), np.uint16).reshape(len(widths), -1), distinct


def _summing(centroids: np.ndarray, block: int):
    """For each task the sums of components and the number of vectors of each centroid (as one more column)."""
    clusters, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        for _, codes, entries in _chunks(batches, dimensions, block):
            nearest = distances(codes, entries, centroids).argmin(axis=1)
            counts += np.bincount(nearest, minlength=clusters)
            start = 0
            for code, distinct in zip(codes, entries):
                # How often each centroid has each distinct subvector, then the sum of these.
                size = len(distinct)
                often = np.bincount(nearest * size + code, minlength=clusters * size).reshape(clusters, size)
                sums[:, start : start + distinct.shape[1]] += often @ distinct
                start += distinct.shape[1]
        table = np.concatenate([sums, counts[:, None]], axis=1)
        cluster, place = np.nonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(table[cluster, place])],
            names=["cluster", "place", "total"],
        )

    return add


def _assigning(centroids: np.ndarray, block: int):
    dimensions = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, entries in _chunks(batches, dimensions, block):
            all_ = distances(codes, entries, centroids)
            nearest = all_.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nearest.astype(np.int32)), pa.array(all_[np.arange(len(nearest)), nearest])],
                names=["vec_id", "cluster", "distance"],
            )

    return assign


# ----------------------------------------------------------------------------------- operator


def clustered(
    vectors: DataFrame,
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
    block: int = BLOCK,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of each kept vector, written, and the final centroids.

    Vectors of another length and those with a null or non-finite component are left out. Repeated rows and
    rows without an id are vectors like any other. With fewer vectors than clusters there are as many
    centroids as vectors; an empty table gives none and no rows. Other columns are ignored. What comes to
    the driver are the centroids and their sums: clusters times dimensions numbers a round.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = whole_vectors(vectors, dimensions, scale, vec_id, embedding)
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    encoded = written(kept.mapInArrow(_encoder(dimensions, block, CHUNK), _ENCODED), "centroid-codes")
    for _ in range(rounds):
        sums = encoded.mapInArrow(_summing(centroids, block), "cluster int, place int, total bigint")
        table = np.zeros((len(centroids), dimensions + 1), np.int64)
        for row in sums.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
            table[row.cluster, row.place] = row.total
        filled = table[:, -1] > 0
        centroids = centroids.copy()
        centroids[filled] = table[filled, :-1] // table[filled, -1:]
    assigned = encoded.mapInArrow(_assigning(centroids, block), "vec_id bigint, cluster int, distance bigint")
    return written(assigned, "centroid-assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the distances summed over the cluster and over all, and the hash of the cluster's centroid."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = [free_name(assigned, n) for n in ("_cluster", "_digest")]
    hashes = assigned.sparkSession.createDataFrame(list(enumerate(digests)), f"{names[0]} int, {names[1]} string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = assigned.agg(F.sum("distance").alias("inertia"))
    # A row for each cluster, however many vectors there are.
    facts = F.broadcast(sums.crossJoin(total).join(hashes, F.col("cluster") == F.col(names[0])))
    facts = facts.select(F.col("cluster").alias(names[0]), "cluster_inertia", "inertia", F.col(names[1]).alias("centroid_sha256"))
    return assigned.join(facts, F.col("cluster") == F.col(names[0])).drop(names[0])


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(load(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """The same rounds spelled out: each vector with its nearest centroid, then floored means."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assign(n: int) -> str:
        return f"""
assigned{n} AS (
  SELECT r, vec_id, x, d.cluster AS cluster, CAST(d.distance AS BIGINT) AS distance
  FROM (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x,
          min({{'distance': {distance}, 'cluster': c.cluster}}) AS d
        FROM kept v, centroids{n} c GROUP BY v.r))"""

    def move(n: int) -> str:
        return f"""
sums{n} AS (
  SELECT cluster, i, sum(v) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(x) AS v, unnest(range(1, {DIMENSIONS + 1})) AS i FROM assigned{n}) GROUP BY cluster, i),
centroids{n + 1} AS (
  SELECT cluster, coalesce(m.x, c.x) AS x FROM centroids{n} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{n} GROUP BY cluster) m
  USING (cluster))"""

    steps = "".join(f"{assign(n)},{move(n)}," for n in range(ROUNDS))
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id,
    list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMENSIONS}),
centroids0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS INTEGER) AS cluster, x
  FROM kept QUALIFY cluster < {CLUSTERS}),{steps}{assign(ROUNDS)}
SELECT vec_id, a.cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM assigned{ROUNDS} a JOIN centroids{ROUNDS} c ON a.cluster = c.cluster"""


SQL = {"op12_centroid_clustering": _sql()}
