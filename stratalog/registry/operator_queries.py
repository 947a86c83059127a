"""One query per operator, on the derived catalogue or on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.config import (
    MOVIE,
    RATING_CATEGORIES,
    REJECTION_REASON,
    TV_SHOW,
    GoldRules,
    SilverRules,
    StrictRules,
)
from stratalog.functions import dates, duration, quality, text
from stratalog.functions.measures import (
    count_where,
    exact_mean,
    exact_sum,
    guarded_percent,
    mean_score,
    percent,
    share_where,
    steps,
    weighted_mean,
    wide_sum,
)
from stratalog.operators import aggregates, cleanse, joins, ranking, reshape, rows, sets, windows
from stratalog.plans import gold as gold_plans
from stratalog.plans import silver as silver_plans
from stratalog.registry.base import (
    ORDER_YEARS,
    GOLD_RULES,
    SILVER_RULES,
    gold,
    on_bronze,
    on_gold,
    on_silver,
    register,
    silver,
    sql_avg,
    sql_count,
    sql_mean,
    sql_on_bronze,
    sql_on_gold,
    sql_on_silver,
    sql_on_tiers,
    sql_percent,
    sql_share,
    sql_text,
    table,
)
from stratalog.sources.sinks import render_arrays

REQUIRED = SILVER_RULES.required


def _bronze(name, plan, select):
    register(name, on_bronze(plan), sql_on_bronze(select))


def _silver(name, plan, select):
    register(name, on_silver(plan), sql_on_silver(select))


# --------------------------------------------------------------- projections, renames, filters
_bronze(
    "b01_rename",
    lambda df: rows.rename(
        df, {"type": "content_type", "listed_in": "genre", "cast": "cast_and_crew"}
    ),
    """SELECT * RENAME ("type" AS content_type, listed_in AS genre, "cast" AS cast_and_crew)
FROM bronze""",
)
_silver(
    "b02_select_subset",
    lambda df: rows.pick(
        df,
        ["show_id", "title", "content_type", "primary_genre", "release_year", "data_quality_score"],
    ),
    """SELECT show_id, title, content_type, primary_genre, release_year, data_quality_score
FROM silver""",
)
_silver(
    "b03_display_labels",
    lambda df: rows.relabel(
        df.groupBy("content_type").agg(F.count(F.lit(1)).alias("n")), ["Content Type", "Titles"]
    ),
    """SELECT content_type AS "Content Type", count(*) AS "Titles" FROM silver GROUP BY 1""",
)
_silver(
    "b04_drop_columns",
    lambda df: rows.drop(
        df, ["duration", "genre", "country", "description", "cast_and_crew", "processed_timestamp"]
    ),
    "SELECT * EXCLUDE (duration, genre, country, description, cast_and_crew) FROM silver",
)
_bronze(
    "b05_not_blank",
    lambda df: rows.keep_present(df, ["show_id", "title", "director"]).select(
        "show_id", "title", "director"
    ),
    """SELECT show_id, title, director FROM bronze
WHERE trim(show_id) <> '' AND trim(title) <> '' AND trim(director) <> ''""",
)
_bronze(
    "b06_not_null",
    lambda df: rows.keep_not_null(df, REQUIRED).select("show_id", "title"),
    "SELECT show_id, title FROM bronze WHERE show_id IS NOT NULL AND title IS NOT NULL",
)
_silver(
    "b07_sentinel_exclusion",
    lambda df: rows.exclude_value(
        rows.exclude_value(df, "director", "Unknown"), "primary_genre", "Uncategorized"
    ).select("show_id", "director", "primary_genre"),
    """SELECT show_id, director, primary_genre FROM silver
WHERE director <> 'Unknown' AND primary_genre <> 'Uncategorized'""",
)
_silver(
    "b08_substring_exclusion",
    lambda df: rows.exclude_containing(df, "director", ",").select("show_id", "director"),
    "SELECT show_id, director FROM silver WHERE strpos(director, ',') = 0",
)
_bronze(
    "b09_ignore_case_search",
    lambda df: df.filter(text.contains_ignore_case("director", "GUEST dir")).select(
        "show_id", "director"
    ),
    "SELECT show_id, director FROM bronze WHERE director ILIKE '%guest dir%'",
)
register(
    "b10_pattern_filter",
    on_silver(
        lambda df: rows.keep_matching(
            gold_plans.with_quality_tier(df), "quality_tier", "Poor|Fair"
        ).select("show_id", "quality_tier", "data_quality_score")
    ),
    sql_on_tiers(
        """SELECT show_id, quality_tier, data_quality_score FROM tiered
WHERE regexp_matches(quality_tier, 'Poor|Fair')"""
    ),
)
_silver(
    "b11_in_list",
    lambda df: rows.keep_in(df, "rating", ["TV-MA", "R", "NC-17"]).select("show_id", "rating"),
    "SELECT show_id, rating FROM silver WHERE rating IN ('TV-MA', 'R', 'NC-17')",
)
_silver(
    "b12_range_and_threshold",
    lambda df: rows.keep_between(
        rows.keep_between(df, "added_year", 2017, 2019), "duration_value", low=100
    ).select("show_id", "added_year", "duration_value"),
    """SELECT show_id, added_year, duration_value FROM silver
WHERE added_year BETWEEN 2017 AND 2019 AND duration_value >= 100""",
)
_silver(
    "b13_all_dates_known",
    lambda df: rows.keep_not_null(df, ["date_added", "added_year", "added_month"]).select(
        "show_id", "date_added", "added_year", "added_month"
    ),
    """SELECT show_id, date_added, added_year, added_month FROM silver
WHERE date_added IS NOT NULL AND added_year IS NOT NULL AND added_month IS NOT NULL""",
)
_bronze(
    "b14_literal_columns",
    lambda df: rows.with_literals(
        df.select("show_id", dates.run_date("2026-02-09").alias("report_date")),
        {"rejection_reason": REJECTION_REASON},
    ),
    f"""SELECT show_id, DATE '2026-02-09' AS report_date,
  '{REJECTION_REASON}' AS rejection_reason FROM bronze""",
)

# -------------------------------------------------------------------- cleansing and quality
_VALID_SQL = "SELECT * FROM bronze WHERE trim(show_id) <> '' AND trim(title) <> ''"
_bronze(
    "c01_valid_rows",
    lambda df: cleanse.valid_rows(df, REQUIRED),
    _VALID_SQL,
)
_bronze(
    "c01_rejected_rows",
    lambda df: silver_plans.rejected(df, SILVER_RULES).drop("rejected_at"),
    f"""SELECT *, '{REJECTION_REASON}' AS rejection_reason FROM bronze
WHERE NOT coalesce(trim(show_id) <> '' AND trim(title) <> '', FALSE)""",
)
_bronze(
    "c02_dedupe_by_key",
    lambda df: cleanse.dedupe(
        cleanse.valid_rows(df, REQUIRED), ["show_id"], [F.col(c) for c in SILVER_RULES.dedupe_order]
    ),
    f"""SELECT * FROM ({_VALID_SQL}) QUALIFY row_number() OVER (PARTITION BY show_id
  ORDER BY title NULLS FIRST, date_added NULLS FIRST, release_year NULLS FIRST) = 1""",
)
register(
    "c02_latest_event_per_user",
    lambda spark, sf_dir: cleanse.dedupe(
        table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], total=True
    ).select("user_id", "event_id", "event_type"),
    """SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
_bronze(
    "c03_blank_defaults",
    lambda df: cleanse.standardise_blanks(
        df, {"director": "Unknown", "cast": "Not Available", "description": "None given"}
    ).select("show_id", "director", "cast", "description"),
    """SELECT show_id, coalesce(nullif(trim(director), ''), 'Unknown') AS director,
  coalesce(nullif(trim("cast"), ''), 'Not Available') AS "cast",
  coalesce(nullif(trim(description), ''), 'None given') AS description FROM bronze""",
)
_bronze(
    "c04_empty_defaults",
    lambda df: cleanse.fill_empty(df, {"director": "Unknown", "description": "None given"}).select(
        "show_id", "director", "description"
    ),
    """SELECT show_id, coalesce(nullif(director, ''), 'Unknown') AS director,
  coalesce(nullif(description, ''), 'None given') AS description FROM bronze""",
)
_bronze(
    "c05_date_parse",
    lambda df: df.select(
        "date_added",
        dates.parse_date(F.trim("date_added"), SILVER_RULES.date_formats).alias("parsed"),
    ),
    """SELECT date_added, CAST(try_strptime(trim(date_added), '%B %d, %Y') AS DATE) AS parsed
FROM bronze""",
)
_bronze(
    "c06_date_sentinel",
    lambda df: df.select(
        "date_added",
        dates.fill_date(
            dates.parse_date(text.strip_whitespace("date_added"), SILVER_RULES.date_formats),
            "1900-01-01",
        ).alias("filled"),
    ),
    """SELECT date_added, coalesce(CAST(try_strptime(trim(date_added), '%B %d, %Y') AS DATE),
  DATE '1900-01-01') AS filled FROM bronze""",
)
_bronze(
    "c07_duration_value",
    lambda df: df.select("duration", duration.duration_value("duration").alias("value")),
    r"""SELECT duration, TRY_CAST(regexp_extract(duration, '(\d+)', 1) AS INTEGER) AS "value"
FROM bronze""",
)
_bronze(
    "c08_duration_unit",
    lambda df: df.select("duration", duration.duration_unit("duration").alias("unit")),
    """SELECT duration, CASE WHEN duration ILIKE '%min%' THEN 'minutes'
  WHEN duration ILIKE '%season%' THEN 'seasons' ELSE 'unknown' END AS unit FROM bronze""",
)
_bronze(
    "c09_number_sentinel",
    lambda df: df.select(
        "release_year",
        duration.int_or(F.col("release_year"), 0).alias("year_or_zero"),
        duration.int_or(F.regexp_extract("duration", r"(\d+)", 1), 0).alias("value_or_zero"),
    ),
    r"""SELECT release_year, coalesce(release_year, 0) AS year_or_zero,
  coalesce(TRY_CAST(regexp_extract(duration, '(\d+)', 1) AS INTEGER), 0) AS value_or_zero
FROM bronze""",
)
_bronze(
    "c10_text_normalise",
    lambda df: df.select(
        "show_id", text.upper_trim("rating").alias("rating"), F.trim("type").alias("content_type")
    ),
    """SELECT show_id, upper(trim(rating)) AS rating, trim("type") AS content_type FROM bronze""",
)
_RATINGS = ", ".join(f"'{r}'" for r in StrictRules().ratings)
_bronze(
    "c11_allow_list",
    lambda df: df.select(
        "rating", text.allow_listed("rating", StrictRules().ratings, "UR").alias("allowed")
    ),
    f"""SELECT rating, CASE WHEN trim(rating) IN ({_RATINGS}) THEN trim(rating) ELSE 'UR' END
  AS allowed FROM bronze""",
)
_silver(
    "c12_temporal_features",
    lambda df: df.select(
        "show_id",
        F.year("date_added").alias("added_year"),
        F.month("date_added").alias("added_month"),
        dates.age_in_years("release_year", 2024).alias("age_in_2024"),
    ),
    """SELECT show_id, CAST(year(date_added) AS INTEGER) AS added_year,
  CAST(month(date_added) AS INTEGER) AS added_month,
  CAST(2024 - release_year AS INTEGER) AS age_in_2024 FROM silver""",
)
_silver(
    "c13_primary_value",
    lambda df: df.select(
        "show_id",
        text.primary_value("genre", "Uncategorized").alias("first_genre"),
        text.primary_value("country", "Unknown").alias("first_country"),
    ),
    """SELECT show_id, trim(split_part(genre, ',', 1)) AS first_genre,
  trim(split_part(country, ',', 1)) AS first_country FROM silver""",
)
_silver(
    "c14_completeness_flags",
    lambda df: df.select(
        "show_id",
        quality.is_known("director", "Unknown").alias("has_director"),
        quality.is_known("cast_and_crew", "Not Available").alias("has_cast"),
    ),
    """SELECT show_id, director <> 'Unknown' AS has_director,
  cast_and_crew <> 'Not Available' AS has_cast FROM silver""",
)
register(
    "c14_label_completeness",
    lambda spark, sf_dir: table(spark, sf_dir, "documents")
    .join(table(spark, sf_dir, "labels"), "doc_id", "left")
    .groupBy("source")
    .agg(
        F.count(F.lit(1)).alias("documents"),
        share_where(F.col("quality").isNotNull()).alias("labelled_pct"),
        count_where(F.col("toxic") == 1).alias("toxic_documents"),
    ),
    f"""SELECT source, count(*) AS documents, {sql_share("quality IS NOT NULL")} AS labelled_pct,
  {sql_count("toxic = 1")} AS toxic_documents
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
_silver(
    "c15_recency_flag",
    lambda df: df.select(
        "show_id", "content_age_years", quality.is_recent("content_age_years", 8).alias("recent")
    ),
    """SELECT show_id, content_age_years, coalesce(content_age_years <= 8, FALSE) AS recent
FROM silver""",
)
_silver(
    "c16_completeness_score",
    lambda df: df.select(
        "show_id",
        quality.completeness_score(
            [F.col("has_director"), F.col("has_cast"), F.col("duration_value").isNotNull()], 3
        ).alias("score"),
    ),
    """SELECT show_id, CAST(has_director::INT + has_cast::INT + (duration_value IS NOT NULL)::INT
  AS DOUBLE) / 3.0 AS score FROM silver""",
)
register(
    "c17_quality_tier",
    on_silver(
        lambda df: gold_plans.with_quality_tier(df).select(
            "show_id", "data_quality_score", "quality_tier"
        )
    ),
    sql_on_tiers("SELECT show_id, data_quality_score, quality_tier FROM tiered"),
)
_BANDS = (("high", 7500.0), ("middle", 2500.0), ("low", 0.0))
register(
    "c17_account_balance_bands",
    lambda spark, sf_dir: table(spark, sf_dir, "customer")
    .withColumn("band", quality.tier("c_acctbal", _BANDS, "negative"))
    .groupBy("band")
    .agg(
        F.count(F.lit(1)).alias("customers"),
        exact_sum("c_acctbal", 2).alias("balance"),
        F.min(quality.tier_position("band", [b for b, _ in _BANDS]).cast("int")).alias("position"),
    ),
    """SELECT band, count(*) AS customers,
  CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100 AS balance,
  CAST(min(CASE band WHEN 'high' THEN 1 WHEN 'middle' THEN 2 WHEN 'low' THEN 3 ELSE 4 END)
    AS INTEGER) AS "position"
FROM (SELECT *, CASE WHEN c_acctbal >= 7500 THEN 'high' WHEN c_acctbal >= 2500 THEN 'middle'
  WHEN c_acctbal >= 0 THEN 'low' ELSE 'negative' END AS band FROM customer) GROUP BY band""",
)
_CATEGORY_SQL = " ".join(
    "WHEN rating IN ({}) THEN '{}'".format(", ".join(f"'{m}'" for m in members), label)
    for label, members in RATING_CATEGORIES
)
_silver(
    "c18_category_mapping",
    lambda df: df.select(
        "show_id", "rating", quality.category("rating", RATING_CATEGORIES, "Other").alias("audience")
    ),
    f"SELECT show_id, rating, CASE {_CATEGORY_SQL} ELSE 'Other' END AS audience FROM silver",
)
_silver(
    "c19_month_names",
    lambda df: df.select("show_id", dates.month_name("added_month").alias("month_name")),
    "SELECT show_id, strftime(date_added, '%B') AS month_name FROM silver",
)
register(
    "c20_text_length",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").alias("text_length")
    ),
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length FROM documents",
)
_silver(
    "c21_audit_columns",
    lambda df: df.select(
        "show_id", F.date_format("processed_timestamp", "yyyy-MM-dd HH:mm").alias("processed")
    ),
    "SELECT show_id, '2026-02-09 12:00' AS processed FROM silver",
)
_bronze(
    "c22_quality_report",
    lambda df: cleanse.quality_report(df, "show_id", REQUIRED),
    """SELECT initial_count, final_count, initial_count - valid_count AS rejected_count,
  valid_count - final_count AS duplicates_removed,
  CAST(final_count AS DOUBLE) / initial_count * 100 AS success_rate
FROM (SELECT count(*) AS initial_count,
    count(*) FILTER (WHERE trim(show_id) <> '' AND trim(title) <> '') AS valid_count,
    count(DISTINCT show_id) FILTER (WHERE trim(show_id) <> '' AND trim(title) <> '')
      AS final_count
  FROM bronze)""",
)
# Blank keys are kept by this profile; the order says which of their rows.
_STRICT = StrictRules(processed_at="2026-02-09 12:00:00")
_bronze(
    "c23_strict_profile",
    lambda df: silver_plans.strict_silver(df, _STRICT).drop("processed_timestamp"),
    rf"""SELECT show_id, "type" AS content_type, title,
  coalesce(nullif(director, ''), 'Unknown') AS director,
  coalesce(nullif("cast", ''), 'Not Available') AS cast_and_crew,
  coalesce(nullif(country, ''), 'Unknown') AS country,
  coalesce(CAST(try_strptime(trim(date_added), '%B %d, %Y') AS DATE), DATE '1900-01-01')
    AS date_added,
  coalesce(release_year, 0) AS release_year,
  CASE WHEN trim(rating) IN ({_RATINGS}) THEN trim(rating) ELSE 'UR' END AS rating,
  duration,
  coalesce(nullif(listed_in, ''), 'Uncategorized') AS genre,
  coalesce(nullif(description, ''), 'No Description Available') AS description,
  coalesce(TRY_CAST(regexp_extract(duration, '(\d+)', 1) AS INTEGER), 0) AS duration_value,
  CASE WHEN duration ILIKE '%min%' THEN 'minutes' WHEN duration ILIKE '%season%' THEN 'seasons'
    ELSE 'unknown' END AS duration_unit,
  CAST(length(coalesce(nullif(description, ''), 'No Description Available')) AS INTEGER)
    AS description_length,
  DATE '2026-02-09' AS processing_date
FROM (SELECT * FROM bronze WHERE show_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY show_id ORDER BY title NULLS FIRST, date_added NULLS FIRST,
    release_year NULLS FIRST) = 1)
WHERE title IS NOT NULL""",
)

# ------------------------------------------------------------------------------------- joins
register(
    "d1_group_totals_join",
    on_gold(
        "geographic_distribution",
        lambda df: joins.with_group_total(
            df.select("primary_country", "content_type", "content_count"),
            ["primary_country"],
            "content_count",
            "country_total",
        ),
    ),
    sql_on_gold(
        "geographic_distribution",
        """SELECT primary_country, content_type, content_count, country_total
FROM geographic_distribution JOIN (SELECT primary_country, CAST(sum(content_count) AS BIGINT)
  AS country_total FROM geographic_distribution GROUP BY 1) USING (primary_country)""",
    ),
)


def _counts_with_samples(df):
    tiered = gold_plans.with_quality_tier(df)
    groups = ["content_type", "quality_tier"]
    counts = tiered.groupBy(*groups).agg(F.count(F.lit(1)).alias("titles"))
    samples = gold_plans.sample_titles(tiered.filter(F.col("release_year") >= 2014), GOLD_RULES)
    return render_arrays(joins.attach(counts, samples, groups))


register(
    "d2_left_join_samples",
    on_silver(_counts_with_samples),
    sql_on_tiers(
        f"""SELECT content_type, quality_tier, titles, {sql_text("sample_titles")} AS sample_titles
FROM (SELECT content_type, quality_tier, count(*) AS titles FROM tiered GROUP BY 1, 2)
LEFT JOIN (SELECT content_type, quality_tier, list(title ORDER BY title, show_id) AS sample_titles
  FROM (SELECT * FROM tiered WHERE release_year >= 2014 QUALIFY row_number() OVER (
    PARTITION BY content_type, quality_tier ORDER BY title, show_id) <= 5) GROUP BY 1, 2)
USING (content_type, quality_tier)"""
    ),
)


def _items_of_top_suppliers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    kept = joins.keep_top_groups(items, "l_suppkey", "l_quantity", 10)
    return kept.groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("items"), exact_sum("l_quantity", 0).alias("quantity")
    )


register(
    "d3_items_of_top_suppliers",
    _items_of_top_suppliers,
    """SELECT l_suppkey, l_returnflag, count(*) AS items, sum(l_quantity) AS quantity
FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1
  ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 10)
GROUP BY 1, 2""",
)

# -------------------------------------------------------------------------------- aggregates
_silver(
    "e01_global_aggregate",
    lambda df: df.agg(
        F.count(F.lit(1)).alias("titles"),
        count_where(F.col("content_type") == MOVIE).alias("movies"),
        mean_score("data_quality_score", 5).alias("score"),
        F.min("date_added").alias("first_added"),
        F.max("release_year").alias("last_year"),
    ),
    """SELECT count(*) AS titles, CAST(sum((content_type = 'Movie')::INT) AS BIGINT) AS movies,
  CAST(sum(CAST(round(data_quality_score * 5) AS BIGINT)) AS DOUBLE) / (5.0 * count(*)) AS score,
  min(date_added) AS first_added, max(release_year) AS last_year FROM silver""",
)
_silver(
    "e02_group_by_two_keys",
    lambda df: df.groupBy("primary_country", "content_type").agg(
        F.count(F.lit(1)).alias("titles"), F.avg("duration_value").alias("mean_duration")
    ),
    f"""SELECT primary_country, content_type, count(*) AS titles,
  {sql_avg("duration_value")} AS mean_duration FROM silver GROUP BY 1, 2""",
)
_silver(
    "e03_group_by_three_keys",
    lambda df: df.groupBy("added_year", "added_month", "content_type").agg(
        F.count(F.lit(1)).alias("titles")
    ),
    """SELECT added_year, added_month, content_type, count(*) AS titles FROM silver
GROUP BY 1, 2, 3""",
)
_silver(
    "e03_group_by_four_keys",
    lambda df: df.groupBy("added_year", "content_type", "rating", "duration_unit").agg(
        F.count(F.lit(1)).alias("titles")
    ),
    """SELECT added_year, content_type, rating, duration_unit, count(*) AS titles FROM silver
GROUP BY 1, 2, 3, 4""",
)
register(
    "e04_roll_gold_up",
    on_gold(
        "genre_analysis",
        lambda df: aggregates.group_totals(
            df, ["primary_genre"], ["content_count", "recent_content_count"]
        ),
    ),
    sql_on_gold(
        "genre_analysis",
        """SELECT primary_genre, CAST(sum(content_count) AS BIGINT) AS content_count,
  CAST(sum(recent_content_count) AS BIGINT) AS recent_content_count
FROM genre_analysis GROUP BY 1""",
    ),
)
_bronze(
    "e05_count_distinct",
    lambda df: df.groupBy("type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("show_id").alias("titles")
    ),
    """SELECT "type", count(*) AS "rows", count(DISTINCT show_id) AS titles FROM bronze
GROUP BY 1""",
)
_bronze(
    "e06_conditional_distinct",
    lambda df: aggregates.distinct_where(
        df,
        ["rating"],
        "show_id",
        {"movies": F.col("type") == MOVIE, "series": F.trim("type") == TV_SHOW},
    ),
    """SELECT rating, count(DISTINCT show_id) FILTER (WHERE "type" = 'Movie') AS movies,
  count(DISTINCT show_id) FILTER (WHERE trim("type") = 'TV Show') AS series
FROM bronze GROUP BY 1""",
)
_silver(
    "e07_conditional_sum",
    lambda df: df.groupBy("primary_country").agg(
        count_where(F.col("added_year") == 2021).alias("added_2021"),
        count_where(F.col("data_quality_score") >= 0.8).alias("high_quality"),
        F.sum(F.when(F.col("duration_unit") == "minutes", F.col("duration_value")).otherwise(0))
        .alias("minutes"),
    ),
    f"""SELECT primary_country, {sql_count("added_year = 2021")} AS added_2021,
  {sql_count("data_quality_score >= 0.8")} AS high_quality,
  CAST(sum(CASE WHEN duration_unit = 'minutes' THEN duration_value ELSE 0 END) AS BIGINT)
    AS minutes FROM silver GROUP BY 1""",
)
_silver(
    "e08_average_and_share",
    lambda df: df.groupBy("rating").agg(
        F.round(F.avg("content_age_years"), 1).alias("mean_age"),
        F.round(share_where(F.col("has_director")), 2).alias("director_pct"),
    ),
    f"""SELECT rating, round({sql_avg("content_age_years")}, 1) AS mean_age,
  round({sql_share("has_director")}, 2) AS director_pct FROM silver GROUP BY 1""",
)
_silver(
    "e09_min_max",
    lambda df: df.groupBy("primary_genre").agg(
        F.min("date_added").alias("first_added"),
        F.max("date_added").alias("last_added"),
        F.min("release_year").alias("first_year"),
        F.max("release_year").alias("last_year"),
    ),
    """SELECT primary_genre, min(date_added) AS first_added, max(date_added) AS last_added,
  min(release_year) AS first_year, max(release_year) AS last_year FROM silver GROUP BY 1""",
)
register(
    "e10_sum_of_counts",
    on_gold(
        "temporal_trends",
        lambda df: aggregates.group_totals(df, ["added_year"], ["content_added_count"]),
    ),
    sql_on_gold(
        "temporal_trends",
        """SELECT added_year, CAST(sum(content_added_count) AS BIGINT) AS content_added_count
FROM temporal_trends GROUP BY 1""",
    ),
)


def _top_parts_per_brand(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    first = windows.top_k(parts, ["p_brand"], order, 3, "position")
    return first.groupBy("p_brand").agg(
        F.array_join(aggregates.list_in_order("p_name", "position"), " | ").alias("dearest")
    )


register(
    "e11_list_of_top_k",
    _top_parts_per_brand,
    """SELECT p_brand, string_agg(p_name, ' | ' ORDER BY p_retailprice DESC, p_partkey) AS dearest
FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand
  ORDER BY p_retailprice DESC, p_partkey) <= 3) GROUP BY 1""",
)
_silver(
    "e12_collect_set",
    lambda df: df.groupBy("primary_country").agg(
        F.array_join(aggregates.sorted_set("rating"), ", ").alias("ratings")
    ),
    """SELECT primary_country, string_agg(DISTINCT rating, ', ' ORDER BY rating) AS ratings
FROM silver GROUP BY 1""",
)
register(
    "e13_first_value",
    lambda spark, sf_dir: table(spark, sf_dir, "customer")
    .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    .groupBy("c_nationkey")
    .agg(
        aggregates.first_known("n_name").alias("n_name"), F.count(F.lit(1)).alias("customers")
    ),
    """SELECT c_nationkey, min(n_name) AS n_name, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
_silver(
    "e14_having",
    lambda df: aggregates.having_at_least(
        aggregates.count_rows(df, ["director"], "titles"), "titles", 12
    ),
    "SELECT director, count(*) AS titles FROM silver GROUP BY 1 HAVING count(*) >= 12",
)


def _peak_hour(spark, sf_dir):
    hours = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return hours.groupBy("event_type").agg(
        F.date_format(aggregates.arg_max("hour", "events"), "yyyy-MM-dd HH").alias("peak_hour"),
        F.max("events").alias("events"),
    )


register(
    "e15_peak_event_hour",
    _peak_hour,
    """SELECT event_type, strftime("hour", '%Y-%m-%d %H') AS peak_hour, events
FROM (SELECT event_type, date_trunc('hour', ts) AS "hour", count(*) AS events
  FROM events GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY events DESC, "hour") = 1""",
)
_silver(
    "e15_row_of_largest_value",
    lambda df: df.filter(F.col("duration_unit") == "minutes")
    .groupBy("primary_genre")
    .agg(
        aggregates.row_of_max(
            ["show_id", "duration_value"], "duration_value", ["show_id"]
        ).alias("longest")
    )
    .select("primary_genre", "longest.show_id", "longest.duration_value"),
    """SELECT primary_genre, show_id, duration_value FROM silver WHERE duration_unit = 'minutes'
QUALIFY row_number() OVER (PARTITION BY primary_genre
  ORDER BY duration_value DESC, show_id) = 1""",
)
register(
    "e16_mean_of_group_sums",
    on_gold(
        "temporal_trends",
        lambda df: aggregates.mean_of_group_sums(
            df, ["added_year", "added_month"], "content_added_count", "mean_per_month"
        ),
    ),
    sql_on_gold(
        "temporal_trends",
        """SELECT CAST(sum(n) AS DOUBLE) / count(*) AS mean_per_month
FROM (SELECT sum(content_added_count) AS n FROM temporal_trends
  GROUP BY added_year, added_month)""",
    ),
)
_silver(
    "e17_distinct_values",
    lambda df: aggregates.distinct_values(df, ["content_type", "rating"]),
    "SELECT DISTINCT content_type, rating FROM silver",
)


def _orders_month_by_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.month("o_orderdate").alias("order_month"),
        F.year("o_orderdate").alias("order_year"),
        F.lit(1).alias("orders"),
    )
    return reshape.pivot_sum(orders, ["order_month"], "order_year", "orders")


register(
    "e18_orders_month_year_pivot",
    _orders_month_by_year,
    f"""SELECT CAST(month(o_orderdate) AS INTEGER) AS order_month,
  {", ".join(f'CAST(count(*) FILTER (WHERE year(o_orderdate) = {y}) AS BIGINT) AS "{y}"' for y in ORDER_YEARS)}
FROM orders GROUP BY 1""",
)


def _nation_years_long(spark, sf_dir):
    # Orders shrink to a row per customer and year before they meet the customers.
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.concat(F.lit("orders_"), F.year("o_orderdate")).alias("order_year"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    counted = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = reshape.pivot_sum(counted, ["c_nationkey"], "order_year", "orders")
    years = [c for c in wide.columns if c != "c_nationkey"]
    return reshape.unpivot(wide, ["c_nationkey"], years, "year", "orders", "orders_")


register(
    "e19_nation_years_unpivot",
    _nation_years_long,
    """SELECT c_nationkey, CAST(y AS VARCHAR) AS "year",
  CAST(count(*) FILTER (WHERE year(o_orderdate) = y) AS BIGINT) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey,
  (SELECT DISTINCT year(o_orderdate) AS y FROM orders) AS t
GROUP BY 1, 2""",
)


def _region_nation_totals(spark, sf_dir):
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"), wide_sum(steps("o_totalprice", 2)).alias("cents"))
    )
    per_nation = (
        per_customer.join(
            table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        .groupBy("c_nationkey")
        .agg(F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))
    )
    named = per_nation.join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reshape.hierarchy_totals(
        named,
        ["r_name", "n_name"],
        [F.sum("orders").alias("orders"), (F.sum("cents").cast("double") / 100).alias("revenue")],
        grand_total=True,
    )


register(
    "e20_region_nation_rollup",
    _region_nation_totals,
    """SELECT r_name, n_name, count(*) AS orders,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue,
  CAST(2 - grouping(r_name) - grouping(n_name) AS INTEGER) AS depth
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""",
)
_silver(
    "e21_guarded_share",
    lambda df: df.groupBy("primary_country").agg(
        guarded_percent(
            count_where(F.col("is_recent") & (F.col("content_type") == MOVIE)),
            count_where(F.col("is_recent")),
        ).alias("movie_share_of_recent")
    ),
    f"""SELECT primary_country, coalesce(
  CAST({sql_count("is_recent AND content_type = 'Movie'")} AS DOUBLE)
    / nullif({sql_count("is_recent")}, 0) * 100, 0.0) AS movie_share_of_recent
FROM silver GROUP BY 1""",
)
register(
    "e22_mean_of_group_means",
    on_gold(
        "rating_distribution",
        lambda df: df.groupBy("content_type").agg(
            exact_mean("avg_quality_score", 3).alias("mean_score"),
            weighted_mean("avg_quality_score", "content_count", 3).alias("weighted_score"),
        ),
    ),
    sql_on_gold(
        "rating_distribution",
        f"""SELECT content_type, {sql_mean("avg_quality_score", 3)} AS mean_score,
  CAST(sum(content_count * CAST(round(avg_quality_score * 1000) AS BIGINT)) AS DOUBLE)
    / (CAST(sum(content_count) AS DOUBLE) * 1000) AS weighted_score
FROM rating_distribution GROUP BY 1""",
    ),
)


def _type_matrix(df):
    by_type = df.groupBy("content_type").agg(
        share_where(F.col("has_director")).alias("director"),
        share_where(F.col("date_added").isNotNull()).alias("date"),
    )
    labels = {"director": "Director", "date": "Date Added"}
    return reshape.transpose(by_type, "content_type", labels, "field", [MOVIE, TV_SHOW])


_silver(
    "e23_transposed_matrix",
    _type_matrix,
    f"""SELECT field, max(v) FILTER (WHERE content_type = 'Movie') AS "Movie",
  max(v) FILTER (WHERE content_type = 'TV Show') AS "TV Show"
FROM (SELECT content_type, 'Director' AS field, {sql_share("has_director")} AS v
      FROM silver GROUP BY 1
      UNION ALL
      SELECT content_type, 'Date Added', {sql_share("date_added IS NOT NULL")}
      FROM silver GROUP BY 1)
GROUP BY field""",
)
_silver(
    "e24_row_count",
    lambda df: aggregates.count_rows(df, ["duration_unit", "content_type"], "records"),
    "SELECT duration_unit, content_type, count(*) AS records FROM silver GROUP BY 1, 2",
)

# ----------------------------------------------------------------------------------- windows


def _type_share_in_brand(spark, sf_dir):
    # Revenue per part first: one row per part meets the part table, however hot a part is.
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000.0).cast("long")
    per_part = (
        table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(wide_sum(cents).alias("units"))
    )
    groups = (
        per_part.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", "p_type")
        .agg(F.sum("units").alias("units"))
    )
    shares = windows.share_of_group(groups, ["p_brand"], "units", "share_of_brand")
    return shares.select(
        "p_brand", "p_type", (F.col("units").cast("double") / 10000.0).alias("revenue"), "share_of_brand"
    )


register(
    "f1_type_share_in_brand",
    _type_share_in_brand,
    f"""SELECT p_brand, p_type, CAST(units AS DOUBLE) / 10000 AS revenue,
  round({sql_percent("units", "sum(units) OVER (PARTITION BY p_brand)")}, 2) AS share_of_brand
FROM (SELECT p_brand, p_type,
    sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS units
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
)


def _monthly_order_value(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM").alias("order_month"),
        steps("o_totalprice", 2).cast("decimal(20,0)").alias("cents"),
    )
    totals = windows.running_total(
        orders, ["o_orderstatus"], ["order_month"], "cents", "cents_so_far"
    )
    return totals.select(
        "o_orderstatus",
        "order_month",
        (F.col("cents").cast("double") / 100).alias("value"),
        (F.col("cents_so_far").cast("double") / 100).alias("value_so_far"),
    )


register(
    "f2_running_order_value",
    _monthly_order_value,
    """SELECT o_orderstatus, order_month, CAST(cents AS DOUBLE) / 100 AS "value",
  CAST(sum(cents) OVER (PARTITION BY o_orderstatus ORDER BY order_month
    ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 100 AS value_so_far
FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS order_month,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1, 2)""",
)


def _top_customers_per_nation(spark, sf_dir):
    value = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(wide_sum(steps("o_totalprice", 2)).alias("cents"))
    )
    customers = value.join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    order = [F.desc("cents"), F.asc("c_custkey")]
    return windows.top_k(customers, ["c_nationkey"], order, 5, "position").select(
        "c_nationkey", "c_custkey", (F.col("cents").cast("double") / 100).alias("value"), "position"
    )


register(
    "f3_top_customers_per_nation",
    _top_customers_per_nation,
    """SELECT c_nationkey, c_custkey, CAST(cents AS DOUBLE) / 100 AS "value",
  CAST(n AS INTEGER) AS "position"
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY cents DESC, c_custkey) AS n
  FROM (SELECT c_nationkey, c_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))
WHERE n <= 5""",
)


def _director_ranks(df):
    groups = df.filter(F.col("director") != "Unknown").groupBy("director", "content_type")
    scored = groups.agg(
        F.count(F.lit(1)).alias("titles"),
        F.round(mean_score("data_quality_score", 5), 3).alias("score"),
    )
    order = [F.desc("titles"), F.desc("score"), F.asc("director")]
    return windows.top_k(scored, ["content_type"], order, 100, "rank")


_silver(
    "f4_rank_with_cut",
    _director_ranks,
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY content_type
    ORDER BY titles DESC, score DESC, director) AS INTEGER) AS "rank"
  FROM (SELECT director, content_type, count(*) AS titles,
      round(CAST(sum(CAST(round(data_quality_score * 5) AS BIGINT)) AS DOUBLE)
        / (5.0 * count(*)), 3) AS score
    FROM silver WHERE director <> 'Unknown' GROUP BY 1, 2)) WHERE "rank" <= 100""",
)
register(
    "f5_running_total_after_filter",
    on_gold(
        "temporal_trends",
        lambda df: windows.running_total(
            df.filter(F.col("added_year") >= 2019),
            ["content_type"],
            ["added_year", "added_month"],
            "content_added_count",
            "cumulative_count",
        ),
    ),
    sql_on_gold(
        "temporal_trends",
        """SELECT content_type, added_year, added_month, content_added_count,
  CAST(sum(content_added_count) OVER (PARTITION BY content_type ORDER BY added_year, added_month
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_count
FROM temporal_trends WHERE added_year >= 2019""",
    ),
)

# --------------------------------------------------------------------------- order and limit
register(
    "g1_order_by_count",
    lambda spark, sf_dir: ranking.order_desc(
        aggregates.count_rows(table(spark, sf_dir, "events"), ["user_id"], "events"),
        "events",
        ["user_id"],
    ),
    """SELECT user_id, count(*) AS events FROM events GROUP BY 1
ORDER BY events DESC, user_id""",
)
register(
    "g2_order_by_mixed_keys",
    lambda spark, sf_dir: ranking.order_mixed(
        table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey"),
        [("s_nationkey", True), ("s_acctbal", False), ("s_suppkey", True)],
    ),
    """SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier
ORDER BY s_nationkey, s_acctbal DESC, s_suppkey""",
)
register(
    "g3_custom_order",
    on_silver(
        lambda df: ranking.order_custom(
            aggregates.count_rows(
                gold_plans.with_quality_tier(df), ["quality_tier"], "titles"
            ).withColumn("position", quality.tier_position("quality_tier", GoldRules().tier_order)),
            "quality_tier",
            GoldRules().tier_order,
        )
    ),
    sql_on_tiers(
        """SELECT quality_tier, count(*) AS titles, CAST(min(CASE WHEN data_quality_score >= 0.9
  THEN 1 WHEN data_quality_score >= 0.7 THEN 2 WHEN data_quality_score >= 0.5 THEN 3 ELSE 4 END)
  AS BIGINT) AS "position" FROM tiered GROUP BY 1"""
    ),
)
register(
    "g4_top_orders",
    lambda spark, sf_dir: ranking.top_n(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"),
        "o_totalprice",
        15,
        ["o_orderkey"],
    ),
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
LIMIT 15""",
)
register(
    "g5_filtered_top_orders",
    lambda spark, sf_dir: ranking.top_n(
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select("o_orderkey", "o_totalprice"),
        "o_totalprice",
        15,
        ["o_orderkey"],
    ),
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""",
)
_silver(
    "g6_head_after_sort",
    lambda df: ranking.order_mixed(
        df.select("show_id", "date_added"), [("date_added", False), ("show_id", True)]
    ).limit(100),
    """SELECT show_id, date_added FROM silver ORDER BY date_added DESC NULLS LAST, show_id
LIMIT 100""",
)

# -------------------------------------------------------------------------------------- sets
_REJECTED_SQL = (
    "SELECT * FROM bronze WHERE NOT coalesce(trim(show_id) <> '' AND trim(title) <> '', FALSE)"
)
_bronze(
    # One side is a filter of the other, so the filter says it all; see the customers for a difference.
    "h1_difference",
    lambda df: sets.difference(df, cleanse.valid_rows(df, REQUIRED)),
    f"SELECT DISTINCT * FROM ({_REJECTED_SQL})",
)
_bronze(
    "h1_distinct_rejects",
    lambda df: silver_plans.rejected(
        df, SilverRules(processed_at="2026-02-09 12:00:00", distinct_rejects=True)
    ).drop("rejected_at", "rejection_reason"),
    f"SELECT DISTINCT * FROM ({_REJECTED_SQL})",
)
_bronze(
    "h1_difference_all",
    lambda df: sets.difference_all(df, cleanse.valid_rows(df, REQUIRED)),
    _REJECTED_SQL,
)
register(
    "h1_customers_without_urgent_orders",
    lambda spark, sf_dir: sets.difference(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")),
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_custkey").alias("custkey")),
    ),
    """SELECT c_custkey AS custkey FROM customer
EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""",
)

# ------------------------------------------------------------------------- scalar functions
_bronze(
    "i1_text_functions",
    lambda df: df.select(
        "show_id",
        F.trim("rating").alias("trimmed"),
        F.upper("rating").alias("uppered"),
        F.lower("director").alias("lowered"),
        F.col("director").contains(",").alias("has_comma"),
        F.split("country", ",")[0].alias("first_part"),
        F.regexp_extract("duration", r"(\d+)", 1).alias("digits"),
        F.replace(F.col("listed_in"), F.lit("Genre "), F.lit("")).alias("replaced"),
        F.concat_ws(" ", "type", F.col("release_year").cast("string")).alias("label"),
        F.length("description").alias("description_length"),
    ),
    r"""SELECT show_id, trim(rating) AS trimmed, upper(rating) AS uppered,
  lower(director) AS lowered, contains(director, ',') AS has_comma,
  split_part(country, ',', 1) AS first_part, regexp_extract(duration, '(\d+)', 1) AS digits,
  replace(listed_in, 'Genre ', '') AS replaced, concat_ws(' ', "type", release_year) AS label,
  CAST(length(description) AS INTEGER) AS description_length FROM bronze""",
)
_silver(
    "i2_date_and_number_functions",
    lambda df: df.select(
        "show_id",
        dates.first_of_month("added_year", "added_month").alias("month_start"),
        F.round(percent("duration_value", "release_year"), 2).alias("ratio"),
        F.col("has_director").cast("int").alias("director_flag"),
        F.coalesce("added_year", F.lit(0)).alias("year_or_zero"),
        F.size(F.split("genre", ",")).alias("genre_parts"),
        quality.producer_type("added_month").alias("bucket"),
    ),
    f"""SELECT show_id, make_date(added_year, added_month, 1) AS month_start,
  round({sql_percent("duration_value", "release_year")}, 2) AS ratio,
  CAST(has_director AS INTEGER) AS director_flag,
  CAST(coalesce(added_year, 0) AS INTEGER) AS year_or_zero,
  CAST(len(string_split(genre, ',')) AS INTEGER) AS genre_parts,
  CASE WHEN added_month <= 2 THEN 'Specialist (1-2)' WHEN added_month <= 4
    THEN 'Moderate (3-4)' ELSE 'Generalist (5+)' END AS bucket
FROM silver""",
)
