"""Each column function on hand-made values: null, blank, junk and mixed case."""

import datetime

import pytest
from pyspark.sql import functions as F

from stratalog.config import QUALITY_TIERS, RATING_CATEGORIES, VALID_RATINGS
from stratalog.functions import dates, duration, measures, quality, text


def apply(spark, values, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


TEXTS = {
    "default_if_blank": (
        lambda: text.default_if_blank("x", "D"), ["a", " a ", "", "  ", None], ["a", "a", "D", "D", "D"]
    ),
    "default_if_empty": (
        lambda: text.default_if_empty("x", "D"), ["a", " a ", "", "  ", None], ["a", " a ", "D", "  ", "D"]
    ),
    "strip_whitespace": (
        lambda: text.strip_whitespace("x"),
        [" a b ", "\t a\n", "　\x1fa\x1c", "", None],
        ["a b", "a", "a", "", None],
    ),
    "upper_trim": (lambda: text.upper_trim("x"), [" tv-ma ", None], ["TV-MA", None]),
    "allow_listed": (
        lambda: text.allow_listed("x", VALID_RATINGS, "UR"),
        [" TV-MA", "tv-ma", "66 min", None, "\tR\n"],
        ["TV-MA", "UR", "UR", "UR", "R"],
    ),
    "primary_value": (
        lambda: text.primary_value("x", "Unknown"),
        ["A, B", " A ,B", "A", "Unknown", None, ",B", ""],
        ["A", "A", "A", "Unknown", "Unknown", "", ""],
    ),
    "contains_ignore_case": (
        lambda: text.contains_ignore_case("x", "a.B"),
        ["xA.by", "xacb", None, ""],
        [True, False, False, False],
    ),
    "matches_ignore_case": (
        lambda: text.matches_ignore_case("x", "a.B"), ["xA.by", "xacb", None], [True, True, False]
    ),
    "null_tokens_to_null": (
        lambda: text.null_tokens_to_null("x", ["NA", "n/a"]), ["NA", "n/a", "na", None], [None, None, "na", None]
    ),
    "duration_value": (
        lambda: duration.duration_value("x"),
        ["90 min", "3 Seasons", "x", "", None, "a12b34", "99999999999 min"],
        [90, 3, None, None, None, 12, None],
    ),
    "duration_unit": (
        lambda: duration.duration_unit("x"),
        ["90 MIN", "1 season", "2 Seasons", "x", None, "min season"],
        ["minutes", "seasons", "seasons", "unknown", "unknown", "minutes"],
    ),
    "int_or": (
        lambda: duration.int_or(F.col("x"), 0), ["12", "12.7", "x", "", None], [12, 12, 0, 0, 0]
    ),
    "category": (
        lambda: quality.category("x", RATING_CATEGORIES, "Other"),
        ["G", "TV-Y7", "TV-14", "NC-17", "UNRATED", "g", None],
        ["Kids & Family", "Older Kids & Teens", "Teens & Adults", "Mature Audiences", "Unrated",
         "Other", "Other"],
    ),
}


@pytest.mark.parametrize("name", TEXTS)
def test_text_functions(spark, name):
    column, values, expected = TEXTS[name]
    assert apply(spark, values, column()) == expected


def test_dates(spark):
    parsed = dates.parse_date(F.trim("x"), ("MMMM d, yyyy", "MMMM dd, yyyy"))
    values = ["September 9, 2021", " May 05, 2020", "bad", "", None, "February 30, 2020"]
    expected = [datetime.date(2021, 9, 9), datetime.date(2020, 5, 5), None, None, None, None]
    assert apply(spark, values, parsed) == expected
    filled = dates.fill_date(parsed, "1900-01-01")
    assert apply(spark, ["bad"], filled) == [datetime.date(1900, 1, 1)]


def test_month_names(spark):
    got = apply(spark, [1, 12, 0, 13, None], dates.month_name("x"), "int")
    assert got == ["January", "December", None, None, None]


def test_age_and_recency(spark):
    assert apply(spark, [2021, None], dates.age_in_years("x", 2026), "int") == [5, None]
    assert apply(spark, [5, 6, None], quality.is_recent("x", 5), "int") == [True, False, False]


def test_tiers(spark):
    tier = quality.tier("x", QUALITY_TIERS, "Poor (<0.5)")
    got = apply(spark, [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, None], tier, "double")
    assert [t.split()[0] for t in got] == [
        "Excellent", "Excellent", "Good", "Good", "Fair", "Fair", "Poor", "Poor",
    ]


def test_tier_position(spark):
    assert apply(spark, ["b", "a", "z", None], quality.tier_position("x", ["a", "b"])) == [2, 1, 3, 3]


def test_producer_type(spark):
    got = apply(spark, [1, 2, 3, 4, 5], quality.producer_type("x"), "int")
    assert [g.split()[0] for g in got] == [
        "Specialist", "Specialist", "Moderate", "Moderate", "Generalist",
    ]


def test_means_do_not_depend_on_row_order(spark):
    df = spark.range(0, 30_000, 1, 7).select((F.lit(4) / F.lit(5.0)).alias("s"), "id")
    for frame in (df, df.repartition(3), df.orderBy(F.desc("id"))):
        row = frame.agg(
            measures.mean_score("s", 5).alias("a"), measures.exact_mean("s", 3).alias("b")
        ).first()
        assert (row.a, row.b) == (0.8, 0.8)


def test_measures_on_nothing(spark):
    df = spark.createDataFrame([], "s double, n long")
    row = df.agg(
        measures.mean_score("s", 5).alias("a"),
        measures.exact_mean("s", 3).alias("b"),
        measures.weighted_mean("s", "n", 3).alias("c"),
        measures.count_where(F.col("n") > 0).alias("d"),
        measures.guarded_percent(F.sum("n"), F.sum("n")).alias("e"),
    ).first()
    assert tuple(row) == (None, None, None, None, 0.0)


def test_guarded_percent_of_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a int, b int")
    got = [r[0] for r in df.select(measures.guarded_percent("a", "b")).collect()]
    assert got == [0.0, 25.0]


def test_weighted_mean_skips_null(spark):
    df = spark.createDataFrame([(1.0, 1), (0.5, 3), (None, 100)], "s double, n int")
    assert df.agg(measures.weighted_mean("s", "n", 3)).first()[0] == 0.625


def test_sums_beyond_a_bigint(spark):
    df = spark.createDataFrame([(9.0e15, 3)] * 3000, "v double, n long")
    out = df.agg(measures.exact_sum("v", 2), measures.exact_mean("v", 2), measures.weighted_mean("v", "n", 2)).first()
    assert out[0] == pytest.approx(2.7e19) and out[1] == out[2] == 9.0e15


@pytest.mark.parametrize("value", [0.5, 0.75])
def test_scores_between_points_are_refused(spark, value):
    df = spark.createDataFrame([(value,)], "s double")
    with pytest.raises(Exception, match="no whole number of 5 points"):
        df.agg(measures.mean_score("s", 5)).collect()
    assert df.agg(measures.mean_score("s", 4)).first()[0] == value


def test_decimals_beyond_the_step_are_refused(spark):
    df = spark.createDataFrame([(1.234,)], "v double")
    with pytest.raises(Exception, match="more than 2 decimals"):
        df.agg(measures.exact_mean("v", 2)).collect()
