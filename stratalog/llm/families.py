"""Exact links inside families of near copies, without pairing their members.

A family is any group of sets that may hold linked ones. Its consensus h has the elements that more than
half of its sets have, and D(x) is what x differs from it by. The difference of two sets is that of their
D, so with c = (100 - percent) / (100 + percent) and w(x) = |D(x)| - c * |x|, two sets are similar enough
if and only if

    w(x) + w(y) <= 2 * |D(x) & D(y)|.

Links that need no common difference, w(x) + w(y) <= 0, hold between the set of least w and both x and y:
a star with as many links as sets covers them. All other links share at least (w(x) + w(y)) / 2
differences. Differences that at most three sets have are listed with the pairs that share them. A pair
that shares none of these shares so many of the others that, in the order of rarity, it must share one of
the first few of each. Each of these names a smaller family, of half the size at most, because a difference
that more had would belong to the consensus. There all agree on one more difference, and the same is done
again. Components formed so far are merged between two rounds, so what is linked already leaves.

Families of bounded size are settled whole, each inside one task, which gives no more links than merges.
Of others only families of a few sets are compared pair by pair, and those which splitting would not make
cheaper.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import discard, give_back, ship, written
from stratalog.llm.components import components

FEW = 8  # families of so many sets are compared pair by pair
#: Families of so many sets and elements at most are settled inside a task: 4 MB of sets, 511 comparisons a set at most.
TASK_SETS, TASK_ELEMENTS = 512, 1 << 19
_BLOCK = 4096  # elements whose bits are held at once, a multiple of 64: 2 MB
RARE = 3  # differences of so many sets list the pairs that share them
#: From this round on a family is also compared pair by pair if splitting does not halve its pairs.
SPLIT_FREELY = 2

_LINKS = "low bigint, high bigint, part_a bigint, part_b bigint"


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<i8")


def _each_element(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of the row but the last, which is its set, for each element."""
    for batch in batches:
        kept, names = batch.columns[:-1], batch.schema.names[:-1]
        start, held = 0, 0
        lengths = [len(s.as_buffer()) // 8 for s in batch.columns[-1]]
        for end, length in enumerate(lengths, start=1):
            held += length
            if held >= 1 << 16 or end == len(lengths):
                rows = np.repeat(np.arange(start, end), lengths[start:end])
                sets = [_set(s) for s in batch.columns[-1][start:end]]
                elements = pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in kept), elements], names=[*names, "element"])
                start, held = end, 0
    give_back()


def _elements(rows: DataFrame, *columns: str) -> DataFrame:
    kinds = ", ".join(f"{c} bigint" for c in (*columns, "element"))
    return rows.select(*columns, "members").mapInArrow(_each_element, kinds)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the consensus, becomes the difference of ``members`` from it."""
    for batch in batches:
        names = batch.schema.names[:-2]
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [
                np.setxor1d(_set(x), np.array(h.values, np.int64) if h.is_valid else np.empty(0, np.int64), assume_unique=True)
                for x, h in zip(part.columns[-2], part.columns[-1])
            ]
            sizes, sets = pa.array([len(d) for d in found], pa.int64()), pa.array([d.tobytes() for d in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], sizes, sets], names=[*names, "size", "members"])


def common_elements(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, counting the bits that rows of bits share."""
    common = np.zeros((len(sets), len(sets)), np.int64)
    joined = np.concatenate([*sets, np.empty(0, np.int64)])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements, column, times = np.unique(joined, return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)  # those of one set only are in no common part
    column = number[column]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for start in range(0, int(number.max(initial=-1)) + 1, _BLOCK):
        a, b = np.searchsorted(column, [start, start + _BLOCK])
        block = np.zeros((len(sets), _BLOCK), bool)
        block[rows[a:b], column[a:b] - start] = True
        bits = np.packbits(block, axis=1).view(np.uint64)
        for k, own in enumerate(bits):
            common[k] += np.bitwise_count(bits & own).sum(axis=1, dtype=np.int64)
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def _in_task(percent: int):
    """Links of one family that make up a spanning forest of its parts: as many as merges."""

    def settle(family: pa.Table) -> pa.Table:
        nodes, parts, totals = (family.column(c).to_numpy() for c in ("node", "part", "n"))
        sets = [_set(s) for s in family.column("members")]
        sizes = np.array([len(s) for s in sets], np.int64)
        apart = sizes[:, None] + sizes - 2 * common_elements(sets)
        linked = (100 + percent) * apart <= (100 - percent) * (totals[:, None] + totals)
        names, own = np.unique(parts, return_inverse=True)
        new = np.ones(len(names), bool)
        found: list[tuple[int, int]] = []
        for first in range(len(names)):
            waiting = list(np.flatnonzero(own == first)) if new[first] else []
            new[first] = False
            while waiting:
                x = waiting.pop()
                reached = np.flatnonzero(linked[x] & new[own])
                others, at = np.unique(own[reached], return_index=True)
                new[others] = False
                found.extend((x, y) for y in reached[at])
                waiting.extend(np.flatnonzero(np.isin(own, others)) if len(others) else [])
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        low, high = np.minimum(nodes[x], nodes[y]), np.maximum(nodes[x], nodes[y])
        part_a, part_b = np.minimum(parts[x], parts[y]), np.maximum(parts[x], parts[y])
        return pa.table({"low": low, "high": high, "part_a": part_a, "part_b": part_b})

    return settle


def _similar(percent: int):
    """Links among pairs: the difference of two sets is that of their differences from anything."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("total").to_numpy()
            apart = np.array(
                [len(np.setxor1d(_set(a), _set(b), assume_unique=True)) for a, b in zip(batch.column("left_set"), batch.column("right_set"))],
                dtype=np.int64,
            )
            keep = (100 + percent) * apart <= (100 - percent) * total
            yield batch.select(["low", "high", "part_a", "part_b"]).filter(pa.array(keep))

    return check


def _checked(pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` of rows l and r, settled on their sets."""
    return pairs.select(
        F.least("l.node", "r.node").alias("low"), F.greatest("l.node", "r.node").alias("high"),
        F.least("l.part", "r.part").alias("part_a"), F.greatest("l.part", "r.part").alias("part_b"),
        (F.col("l.n") + F.col("r.n")).alias("total"),
        F.col("l.members").alias("left_set"), F.col("r.members").alias("right_set"),
    ).mapInArrow(_similar(percent), _LINKS)


def _pair_by_pair(rows: DataFrame, percent: int) -> DataFrame:
    """Links within families, comparing sets of other components whose sizes allow one."""
    size = {side: F.octet_length(f"{side}.members") / 8 for side in "lr"}
    fits = (100 + percent) * F.abs(size["l"] - size["r"]) <= (100 - percent) * (F.col("l.n") + F.col("r.n"))
    same = (F.col("l.family") == F.col("r.family")) & (F.col("l.node") < F.col("r.node"))
    pairs = rows.alias("l").join(rows.alias("r"), same & (F.col("l.part") != F.col("r.part")) & fits)
    return _checked(pairs, percent)


def _ceil_half(total: Column, percent: int) -> Column:
    """The least number of common differences, from weights in units of 1 / (100 + percent)."""
    return F.ceil(total / F.lit(2 * (100 + percent))).cast("long")


def _round(members: DataFrame, percent: int, depth: int, scratch: list[str]) -> tuple[list[DataFrame], DataFrame | None]:
    """Links of one round, and the smaller families that are left, if any."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, f"family-{name}", with_path=True)
        scratch.append(path)
        return table

    sizes = members.groupBy("family").agg(
        F.count(F.lit(1)).alias("sets"), F.sum(F.octet_length("members") / 8).alias("elements"),
        F.min("part").alias("_a"), F.max("part").alias("_b"),
    )
    bounded = (F.col("sets") <= TASK_SETS) & (F.col("elements") <= TASK_ELEMENTS)
    sizes = sizes.where("_a < _b").select("family", "sets", bounded.alias("bounded"))
    sized = kept(members.join(kept(sizes, "sizes"), "family"), "members")
    links = [sized.where("bounded").groupBy("family").applyInArrow(_in_task(percent), _LINKS)]
    larger = sized.where("NOT bounded").drop("bounded")
    few, large = larger.where(F.col("sets") <= FEW), larger.where(F.col("sets") > FEW)
    if not few.isEmpty():
        links.append(_pair_by_pair(few, percent))
    if large.isEmpty():
        return links, None

    # The difference of each set from the consensus of its family, and the star of the least weight.
    consensus = (
        _elements(large, "family", "sets").groupBy("family", "sets", "element").count()
        .where("2 * count > sets").groupBy("family").agg(F.collect_list("element").alias("consensus"))
    )
    apart = large.join(kept(consensus, "consensus"), "family", "left").select(
        "family", "node", "n", "part", "members", "consensus"
    ).mapInArrow(_differences, "family bigint, node bigint, n bigint, part bigint, size bigint, members binary")
    apart = kept(apart.withColumn("weight", (100 + percent) * F.col("size") - (100 - percent) * F.col("n")), "apart")
    least = apart.groupBy("family").agg(F.min(F.struct("weight", "node", "part")).alias("_least"))
    least = least.select(
        "family", F.col("_least.weight").alias("least"), F.col("_least.node").alias("center"), F.col("_least.part").alias("center_part")
    )
    star = (F.col("weight") + F.col("least") <= 0) | (F.col("node") == F.col("center"))
    starred = kept(
        apart.join(kept(least, "least"), "family").withColumns(
            {"star": star, "settled": star | (F.col("part") == F.col("center_part"))}
        ),
        "starred",
    )
    links.append(
        starred.where("star AND node <> center").select(
            F.least("node", "center").alias("low"), F.greatest("node", "center").alias("high"),
            F.least("part", "center_part").alias("part_a"), F.greatest("part", "center_part").alias("part_b"),
        )
    )

    # Sets outside the star, and what they may be linked with, with the differences they must share.
    open_ = starred.groupBy("family").agg(F.count_if(~F.col("settled")).alias("_n")).where("_n > 0").select("family")
    partner = F.when(F.col("settled"), F.greatest(F.col("least"), 1 - F.col("least"))).otherwise(F.col("least"))
    active = starred.join(kept(open_, "open"), "family").select(
        "family", "node", "n", "settled", "size", "weight", "members",
        F.when(F.col("settled"), F.col("center_part")).otherwise(F.col("part")).alias("part"),
        _ceil_half(F.col("weight") + partner, percent).alias("need"),
    )
    active = kept(active.where("need <= size"), "active")
    if active.isEmpty():
        return links, None
    tally = kept(
        _elements(active, "family", "node").groupBy("family", "element").agg(
            F.count(F.lit(1)).alias("sets"), F.min("node").alias("first"), F.max("node").alias("last"),
            F.bit_xor("node").alias("all"),
        ),
        "tally",
    )

    # Rare differences: the pairs that share them, if these and the frequent ones can suffice.
    first, last = F.col("first"), F.col("last")
    middle = F.col("all").bitwiseXOR(first).bitwiseXOR(last)
    nodes = F.array_distinct(F.when(F.col("sets") < RARE, F.array(first, last)).otherwise(F.array(first, middle, last)))
    rare = kept(tally.where(F.col("sets") <= RARE).select("family", nodes.alias("nodes")), "rare")
    own = rare.select("family", F.explode("nodes").alias("node")).groupBy("family", "node").agg(F.count(F.lit(1)).alias("rare"))
    known = kept(
        active.join(own, ["family", "node"], "left")
        .withColumn("frequent", F.col("size") - F.coalesce("rare", F.lit(0)))
        .drop("rare"),
        "known",
    )
    two = F.struct(F.col("nodes")[0].alias("low"), F.col("nodes")[1].alias("high"))
    more = [F.struct(F.col("nodes")[i].alias("low"), F.col("nodes")[2].alias("high")) for i in (0, 1)]
    listed = F.when(F.size("nodes") == RARE, F.array(two, *more)).otherwise(F.array(two))
    shared = (
        rare.where(F.size("nodes") > 1).select("family", F.inline(listed)).groupBy("family", "low", "high").agg(F.count(F.lit(1)).alias("shared"))
    )
    slim = known.drop("members")
    sharing = (
        shared.alias("p")
        .join(slim.alias("l"), (F.col("p.family") == F.col("l.family")) & (F.col("p.low") == F.col("l.node")))
        .join(slim.alias("r"), (F.col("p.family") == F.col("r.family")) & (F.col("p.high") == F.col("r.node")))
        .where(F.col("l.part") != F.col("r.part"))
        .where(
            F.col("l.weight") + F.col("r.weight")
            <= 2 * (100 + percent) * (F.col("p.shared") + F.least("l.frequent", "r.frequent"))
        )
    )
    sharing = kept(sharing.select("p.family", "p.low", "p.high"), "sharing")
    links.append(
        _checked(
            sharing.alias("p")
            .join(known.alias("l"), (F.col("p.family") == F.col("l.family")) & (F.col("p.low") == F.col("l.node")))
            .join(known.alias("r"), (F.col("p.family") == F.col("r.family")) & (F.col("p.high") == F.col("r.node"))),
            percent,
        )
    )

    # Frequent differences: the first few of each set in the order of rarity name smaller families.
    able = kept(known.where("frequent >= need"), "able")
    if able.isEmpty():
        return links, None
    in_order = Window.partitionBy("family", "node").orderBy("sets", "element")
    keys = (
        _elements(able, "family", "node", "frequent", "need", "part")
        .join(tally.where(F.col("sets") > RARE).select("family", "element", "sets"), ["family", "element"])
        .withColumn("place", F.row_number().over(in_order))
        .where("place <= frequent - need + 1")
        .select("family", "element", "node", "part")
    )
    keys = kept(keys, "keys")
    children = keys.groupBy("family", "element").agg(
        F.count(F.lit(1)).alias("sets"), F.min("part").alias("_a"), F.max("part").alias("_b")
    )
    children = kept(children.where("_a < _b").select("family", "element", "sets"), "children")
    pairs = F.col("sets") * (F.col("sets") - 1) / 2
    costs = children.groupBy("family").agg(F.sum("sets").alias("copies"), F.sum(pairs).alias("pairs"))
    whole = able.groupBy("family").agg(F.count(F.lit(1)).alias("sets"))
    splitting = F.col("copies") if depth < SPLIT_FREELY else F.greatest(F.col("copies"), 2 * F.col("pairs"))
    dense = kept(whole.join(costs, "family").where(splitting >= pairs).select("family"), "dense")
    links.append(_pair_by_pair(able.join(dense, "family"), percent))
    apart_again = children.join(dense, "family", "left_anti").select("family", "element")
    smaller = (
        keys.select("family", "element", "node")
        .join(kept(apart_again, "split"), ["family", "element"])
        .join(able, ["family", "node"])
        .select(F.xxhash64("family", "element").alias("family"), "node", "n", "part", "members")
    )
    return links, kept(smaller, "smaller")


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``low, high`` that join what is linked in any family, one or more for each merge.

    ``members``: family, node, n (elements of its whole set), part (the component it is in already),
    members (its set, 64-bit numbers as bytes). Every pair of one family and of two parts that is similar
    enough ends in one component by these links. A node may be in several families.
    """
    spark = members.sparkSession
    ship(spark)
    found: list[DataFrame] = []
    depth = 0
    while members is not None:
        scratch: list[str] = []
        links, smaller = _round(members, percent, depth, scratch)
        links = written(reduce(DataFrame.union, links), "family-links")
        found.append(links.select("low", "high"))
        members = None
        if smaller is not None and not smaller.isEmpty():
            merged = written(components(links.where("part_a < part_b").select("part_a", "part_b")), "family-parts")
            merged = merged.toDF("part", "merged")
            members, path = written(
                smaller.join(merged, "part", "left").select(
                    "family", "node", "n", F.coalesce("merged", "part").alias("part"), "members"
                ),
                "family-next", with_path=True,
            )
        discard(spark, *scratch)
        depth += 1
    return reduce(DataFrame.union, found)
