"""Connected components of links, by union-find inside partitions and parents between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import discard, ship, written

_LINKS = "parent bigint, child bigint"
#: What is left of links of at most this number, 1 MB of them, is put together in one task.
LINKS_IN_TASK = 1 << 16


class UnionFind:
    """Sets of numbers; the root of a set is its smallest number."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (above := self.parent.setdefault(top, top)) != top:
            top = above
        while self.parent[x] != top:  # shorten the path
            self.parent[x], x = top, self.parent[x]
        return top

    def union(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(x, y)
    pairs = [(sets.root(x), x) for x in sets.parent]
    pairs = [(r, x) for r, x in pairs if r != x]
    for start in range(0, len(pairs), 65_536):
        part = pairs[start : start + 65_536]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in part], pa.int64()), pa.array([x for _, x in part], pa.int64())],
            names=["parent", "child"],
        )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every number in ``links`` (two bigint columns), the smallest being the name.

    Each round: every partition keeps only a spanning forest of its links; every child keeps its
    smallest parent, its other parents are linked to that one, and parents are replaced by theirs,
    which halves the paths. It ends when all parents are roots. A task keeps the links of one partition;
    children are grouped with a map-side combine, so a node with very many links is no burden. Rounds are
    for what no task should hold: once the forests of all partitions have ``LINKS_IN_TASK`` links or fewer,
    one more forest of these is the end.
    """
    ship(links.sparkSession)
    edges = links.toDF("parent", "child")
    previous = None
    while True:
        forest, forest_path = written(edges.mapInArrow(_forest, _LINKS), "forest", with_path=True)
        if forest.count() <= LINKS_IN_TASK:
            edges = written(forest.coalesce(1).mapInArrow(_forest, _LINKS), "parents")
            discard(links.sparkSession, forest_path, *([previous] if previous else []))
            break
        chosen = forest.groupBy("child").agg(F.min("parent").alias("parent"))
        above = chosen.toDF("parent", "higher")
        other = forest.join(chosen.toDF("child", "chosen"), "child").where("parent > chosen").select(
            F.col("chosen").alias("parent"), F.col("parent").alias("child"), F.lit(1).alias("open")
        )
        moved = chosen.join(above, "parent", "left").select(
            F.coalesce("higher", "parent").alias("parent"),
            "child",
            F.when(F.col("higher").isNotNull(), 1).otherwise(0).alias("open"),
        )
        edges, path = written(moved.unionByName(other), "parents", with_path=True)
        discard(links.sparkSession, forest_path, *([previous] if previous else []))
        previous = path
        if not edges.where("open = 1").limit(1).count():
            break
        edges = edges.select("parent", "child")
    roots = edges.select(F.col("parent").alias("node")).distinct()
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
