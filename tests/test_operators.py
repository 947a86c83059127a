"""Operators against brute force in Python, under different partitionings and hot keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratalog.operators import aggregates, cleanse, joins, ranking, reshape, rows, sets, windows


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, and many rows are exact copies."""
    rng = random.Random(7)
    data = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(400)}"
        data.append((key, rng.randrange(5), rng.randrange(50)))
    data += data[:2000]
    return data, spark.createDataFrame(data, "k string, g int, v int").repartition(8)


def test_dedupe_is_deterministic_and_keeps_every_key(hot):
    data, df = hot
    results = [
        tuples(cleanse.dedupe(part, ["k"]))
        for part in (df, df.repartition(3, "v"), df.orderBy("v"), df.coalesce(1))
    ]
    assert all(r == results[0] for r in results)
    assert [r[0] for r in results[0]] == sorted({d[0] for d in data}, key=repr)
    assert set(results[0]) <= set(data)


def test_dedupe_by_order(hot):
    data, df = hot
    best = {}
    for k, g, v in data:
        best[k] = max(best.get(k, (-1, -1)), (v, g))
    got = cleanse.dedupe(df, ["k"], [F.desc("v"), F.desc("g")])
    assert tuples(got) == sorted(((k, g, v) for k, (v, g) in best.items()), key=repr)


def test_dedupe_limits_before_the_shuffle(hot):
    plan = cleanse.dedupe(hot[1], ["k"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("hashpartitioning(k")
    assert "WindowGroupLimit" in plan[exchange:] and "WindowGroupLimit" in plan[:exchange]


def test_valid_and_rejected_make_the_input(spark):
    data = [("a", "t"), ("a", "t"), (None, "t"), (None, "t"), ("  ", "t"), ("b", ""), ("c", None)]
    df = spark.createDataFrame(data, "show_id string, title string")
    valid = cleanse.valid_rows(df, ["show_id", "title"])
    rejected = cleanse.rejected_rows(df, ["show_id", "title"], "why", F.current_timestamp())
    assert tuples(valid) == [("a", "t")] * 2
    assert rejected.count() == 5
    assert {r.rejection_reason for r in rejected.collect()} == {"why"}
    both = valid.unionByName(rejected.select("show_id", "title"))
    assert tuples(both) == sorted(data, key=repr)


def test_quality_report(spark):
    df = spark.createDataFrame(
        [("a", "t"), ("a", "t"), ("b", "t"), (None, "t")], "show_id string, title string"
    )
    report = cleanse.quality_report(df, "show_id", ["show_id", "title"])
    assert tuple(report.first()) == (4, 2, 1, 1, 50.0)
    empty = cleanse.quality_report(df.limit(0), "show_id", ["show_id", "title"])
    assert tuple(empty.first()) == (0, 0, 0, 0, 0.0)


def test_differences(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "a int, b string")
    right = spark.createDataFrame([(2, "x"), (1, None)], "a int, b string")
    assert tuples(sets.difference(left, right)) == [(3, "y")]
    assert tuples(sets.difference_all(left, right)) == [(1, None), (3, "y")]
    none = right.limit(0)
    assert tuples(sets.difference(left, none)) == [(1, None), (2, "x"), (3, "y")]
    assert sets.difference_all(left, none).count() == 4


def test_bag_difference_with_a_hot_row(spark):
    left = spark.range(0, 25_003, 1, 4).select(F.lit("hot").alias("a"), F.lit(None).cast("int").alias("b"))
    left = left.union(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b int"))
    right = spark.createDataFrame([("hot", None), ("x", 1), ("z", 9)], "p string, q int")
    got = sets.difference_all(left, right)
    assert got.columns == ["a", "b"]
    counts = {(r.a, r.b): r["count"] for r in got.groupBy("a", "b").count().collect()}
    assert counts == {("hot", None): 25_002, ("x", 1): 1, ("y", 2): 1}
    assert got.exceptAll(left.exceptAll(right)).isEmpty()


def test_top_k_against_brute_force(hot):
    data, df = hot
    groups = defaultdict(list)
    for i in set(data):
        groups[i[1]].append(i)
    expected = []
    for members in groups.values():
        members.sort(key=lambda r: (-r[2], r[0]))
        expected += [(*m, n + 1) for n, m in enumerate(members[:4])]
    got = windows.top_k(df.distinct(), ["g"], [F.desc("v"), F.asc("k")], 4, "n")
    assert tuples(got) == sorted(expected, key=repr)


def test_running_total_against_brute_force(hot):
    data, df = hot
    sums = defaultdict(int)
    for _, g, v in data:
        sums[g, v] += v
    expected, total = [], defaultdict(int)
    for (g, v), s in sorted(sums.items()):
        total[g] += s
        expected.append((g, v, s, total[g]))
    got = windows.running_total(df.withColumn("o", F.col("v")), ["g"], ["o"], "v", "so_far")
    assert tuples(got) == sorted(expected, key=repr)


def test_share_of_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5), ("c", 0)], "g string, n int")
    got = windows.share_of_group(df, ["g"], "n", "pct")
    assert tuples(got) == [("a", 1, 25.0), ("a", 3, 75.0), ("b", 5, 100.0), ("c", 0, None)]


def test_group_total_join_equals_window(hot):
    _, df = hot
    counts = df.groupBy("g", "k").agg(F.count("*").alias("n"))
    joined = joins.with_group_total(counts, ["g"], "n", "t").withColumn("p", F.col("n") / F.col("t"))
    share = windows.share_of_group(counts, ["g"], "n", "p100", None)
    left = {(r.g, r.k): r.p for r in joined.collect()}
    right = {(r.g, r.k): r.p100 / 100 for r in share.collect()}
    assert left.keys() == right.keys()
    assert all(abs(left[k] - right[k]) < 1e-12 for k in left)


def test_attach_keeps_rows_without_partner(spark):
    left = spark.createDataFrame([(1,), (2,)], "a int")
    right = spark.createDataFrame([(1, "x")], "a int, b string")
    assert tuples(joins.attach(left, right, ["a"])) == [(1, "x"), (2, None)]


def test_keep_top_groups(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("b", 3), ("c", 5), ("d", 1)], "k string, v int")
    got = joins.keep_top_groups(df, "k", "v", 2)
    # c ties with a for the second place; the smaller key wins.
    assert tuples(got) == [("a", 5), ("b", 3), ("b", 3)]


def test_top_n_and_orders(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", None), ("d", 1)], "k string, v int")
    assert [r.k for r in ranking.top_n(df, "v", 3, ["k"]).collect()] == ["a", "b", "d"]
    assert [r.k for r in ranking.order_desc(df, "v", ["k"]).collect()] == ["a", "b", "d", "c"]
    mixed = ranking.order_mixed(df.na.drop(), [("v", False), ("k", True)])
    assert [r.k for r in mixed.collect()] == ["a", "b", "d"]
    custom = ranking.order_custom(df, "k", ["d", "b"])
    assert [r.k for r in custom.collect()] == ["d", "b", "a", "c"]


def test_arg_max_prefers_the_smallest_key(spark):
    df = spark.createDataFrame([("b", 7), ("a", 7), ("c", 1)], "k string, v int")
    assert df.agg(aggregates.arg_max("k", "v")).first()[0] == "a"
    row = df.agg(aggregates.row_of_max(["k", "v"], "v", ["k"]).alias("r")).first().r
    assert (row.k, row.v) == ("a", 7)


def test_lists_and_sets(spark):
    df = spark.createDataFrame([(2, "x"), (1, "z"), (3, "x")], "n int, t string").repartition(3)
    row = df.agg(aggregates.list_in_order("t", "n"), aggregates.sorted_set("t")).first()
    assert row[0] == ["z", "x", "x"] and row[1] == ["x", "z"]


def test_mean_of_group_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert aggregates.mean_of_group_sums(df, ["k"], "v", "m").first().m == 4.0


def test_pivot_fills_missing_cells(spark):
    df = spark.createDataFrame([(1, 2019, 5), (1, 2019, 2), (2, 2020, 1)], "m int, y int, n int")
    fixed = reshape.pivot_sum(df, ["m"], "y", "n", [2019, 2020, 2021])
    assert fixed.columns == ["m", "2019", "2020", "2021"]
    assert tuples(fixed) == [(1, 7, 0, 0), (2, 0, 1, 0)]
    found = reshape.pivot_sum(df, ["m"], "y", "n")
    assert found.columns == ["m", "2019", "2020"]


def test_unpivot(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, added_1 int, added_2 int")
    got = reshape.unpivot(df, ["k"], ["added_1", "added_2"], "y", "n", "added_")
    assert tuples(got) == [("a", "1", 1), ("a", "2", 2)]


def test_hierarchy_totals_tell_null_keys_from_totals(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "p string, q string, n int")
    got = reshape.hierarchy_totals(df, ["p", "q"], [F.sum("n").alias("n")], grand_total=True)
    assert tuples(got) == sorted(
        [("a", None, 1, 2), ("a", "x", 2, 2), (None, "x", 4, 2), ("a", None, 3, 1),
         (None, None, 4, 1), (None, None, 7, 0)], key=repr,
    )
    assert reshape.hierarchy_totals(df, ["p", "q"], [F.sum("n").alias("n")]).count() == 5


def test_transpose(spark):
    df = spark.createDataFrame([("t1", 1.0, 2.0), ("t2", 3.0, None)], "t string, a double, b double")
    got = reshape.transpose(df, "t", {"a": "A", "b": "B"}, "field", ["t1", "t2", "t3"])
    assert got.columns == ["field", "t1", "t2", "t3"]
    assert tuples(got) == [("A", 1.0, 3.0, None), ("B", 2.0, None, None)]


def test_row_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b,c", 2), (None, 3), (" ", 4)], "s string, n int")
    assert [r.n for r in rows.keep_present(df, ["s"]).collect()] == [1, 2]
    assert [r.n for r in rows.keep_not_null(df, ["s"]).collect()] == [1, 2, 4]
    assert [r.n for r in rows.exclude_value(df, "s", "a").collect()] == [2, 4]
    assert [r.n for r in rows.exclude_containing(df, "s", ",").collect()] == [1, 4]
    assert [r.n for r in rows.keep_matching(df, "s", "a|b").collect()] == [1, 2]
    assert [r.n for r in rows.keep_in(df, "s", ["a"]).collect()] == [1]
    assert rows.keep_in(df, "s", None).count() == 4
    assert [r.n for r in rows.keep_between(df, "n", 2, 3).collect()] == [2, 3]
    assert [r.n for r in rows.keep_between(df, "n", low=4).collect()] == [4]
    assert rows.keep_between(df, "n").count() == 4
    assert rows.with_literals(df, {"c": "x", "d": 1}).first()["c"] == "x"
    assert rows.relabel(df, ["S", "Count #"]).columns == ["S", "Count #"]
    assert rows.drop(df, ["s"]).columns == ["n"]


def test_pivot_takes_all_values_or_refuses(spark):
    df = spark.createDataFrame([(1, 1994, 2), (1, 1995, 3), (2, 2003, 4)], "m int, y int, n int")
    rows = {r.m: (r["1994"], r["1995"], r["2003"]) for r in reshape.pivot_sum(df, ["m"], "y", "n").collect()}
    assert rows == {1: (2, 3, 0), 2: (0, 0, 4)}
    with pytest.raises(Exception, match="not listed: 2003"):
        reshape.pivot_sum(df, ["m"], "y", "n", [1994, 1995]).collect()


def test_transpose_refuses_unlisted_keys(spark):
    df = spark.createDataFrame([("Movie", 1.0), ("Short", 2.0)], "t string, v double")
    with pytest.raises(Exception, match="not listed: Short"):
        reshape.transpose(df, "t", {"v": "Value"}, "field", ["Movie"]).collect()


def test_conditional_distinct(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, None), ("a", 2, False), ("b", None, True)], "g string, k int, c boolean")
    out = aggregates.distinct_where(df, ["g"], "k", {"n": F.col("c"), "m": ~F.col("c")})
    assert {r.g: (r.n, r.m) for r in out.collect()} == {"a": (1, 1), "b": (0, 0)}
