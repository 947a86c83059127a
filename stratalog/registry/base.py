"""Registration, and the layers that the queries share, in Spark and in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stratalog.config import GoldRules, SilverRules
from stratalog.plans import gold as gold_plans
from stratalog.plans import lattice
from stratalog.plans import silver as silver_plans
from stratalog.session import scratch_path
from stratalog.sources import catalogue, sinks
from stratalog.sources.derived import bronze_catalogue, load

Query = Callable[[SparkSession, str], DataFrame]

# The clock columns get fixed values, so that both engines agree.
SILVER_RULES = SilverRules(processed_at="2026-02-09 12:00:00")
GOLD_RULES = GoldRules(report_date="2026-02-09")


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def sql_text(array: str) -> str:
    """An array rendered as ``sinks.render_arrays`` does."""
    return f"'[' || array_to_string({array}, ', ') || ']'"


def register(name: str, run: Query, sql: str | None) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered twice")
    REGISTRY[name] = Entry(run, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_catalogue(spark, sf_dir)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_plans.silver(bronze(spark, sf_dir), SILVER_RULES)


class Store:
    """Silver and gold of one data folder as tables of a database, each written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.database = f"stratalog_{uuid.uuid4().hex}"
        self.root = scratch_path(spark, "layers")
        self.written: set[str] = set()

    def silver(self) -> DataFrame:
        if "silver" not in self.written:
            sinks.write_partitioned(silver(self.spark, self.sf_dir), f"{self.root}/silver")
            catalogue.register_table(self.spark, self.database, "silver", f"{self.root}/silver", partitioned=True)
            self.written.add("silver")
        return catalogue.read_table(self.spark, self.database, "silver")

    def states(self) -> DataFrame:
        """The states that all gold tables can be rolled up from."""
        if "states" not in self.written:
            sinks.write_parquet(lattice.state_table(self.silver(), GOLD_RULES), f"{self.root}/states")
            catalogue.register_table(self.spark, self.database, "states", f"{self.root}/states")
            self.written.add("states")
        return catalogue.read_table(self.spark, self.database, "states")

    def distincts(self) -> DataFrame:
        """Sets of countries and genres by type, rating and year of addition."""
        if "distincts" not in self.written:
            sinks.write_parquet(gold_plans.distinct_sets(self.silver()), f"{self.root}/distincts")
            catalogue.register_table(self.spark, self.database, "distincts", f"{self.root}/distincts")
            self.written.add("distincts")
        return catalogue.read_table(self.spark, self.database, "distincts")

    def bucketed(self, name: str, key: str, buckets: int = 16) -> DataFrame:
        """One of the given tables, in sorted buckets of its key."""
        by_key = f"{name}_by_{key}"
        if by_key not in self.written:
            rows = load(self.spark, self.sf_dir, name)
            sinks.write_bucketed(rows, self.database, by_key, f"{self.root}/{by_key}", [key], buckets)
            self.written.add(by_key)
        return catalogue.read_table(self.spark, self.database, by_key)

    def gold(self, names: Iterable[str]) -> dict[str, DataFrame]:
        for name in names:
            if name not in self.written:
                table_ = gold_plans.build(name, self.silver(), GOLD_RULES, verify_unique=False)
                sinks.write_parquet(table_, f"{self.root}/{name}")
                catalogue.register_table(self.spark, self.database, name, f"{self.root}/{name}")
                self.written.add(name)
        return catalogue.load_gold(self.spark, self.database, names)


_STORES: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a data folder in this application; another folder has another one."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = Store(spark, sf_dir)
    return _STORES[key]


def gold(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A gold table built from stored silver, whose ids are unique."""
    return gold_plans.build(name, store(spark, sf_dir).silver(), GOLD_RULES, verify_unique=False)


def on_bronze(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(bronze(spark, sf_dir))


def on_silver(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(silver(spark, sf_dir))


def on_gold(name: str, plan: Callable[[DataFrame], DataFrame]) -> Query:
    """A query on the stored gold table, as reports read it."""
    return lambda spark, sf_dir: plan(store(spark, sf_dir).gold([name])[name])


# ---------------------------------------------------------------------------- SQL of the layers

#: Years of the given orders, for SQL that has to list its columns; the queries find them themselves.
ORDER_YEARS = range(1995, 2002)


def sql_mean(column: str, places: int) -> str:
    """Mean of a column with that many decimals, from exact whole steps."""
    scale = 10**places
    return (
        f"(CAST(sum(CAST(round({column} * {scale}) AS BIGINT)) AS DOUBLE)"
        f" / (CAST(nullif(count({column}), 0) AS DOUBLE) * {scale}))"
    )


def sql_avg(column: str) -> str:
    """Mean of a whole-number column."""
    return f"(CAST(sum({column}) AS DOUBLE) / nullif(count({column}), 0))"


def sql_share(condition: str) -> str:
    return f"(CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE) / count(*) * 100)"


def sql_count(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def sql_percent(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE))"


_BLANK = "({0} IS NULL OR trim({0}) = '')"

_BRONZE = """
base AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderpriority,
         c_name, c_mktsegment, n_name, r_name
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
single_titles AS (
  SELECT k,
    CASE WHEN k % 211 = 0 THEN NULL WHEN k % 223 = 0 THEN '  ' ELSE 's' || k END AS show_id,
    CASE WHEN k % 10 < 7 THEN 'Movie' ELSE ' TV Show ' END AS "type",
    CASE WHEN k % 227 = 0 THEN NULL WHEN k % 229 = 0 THEN '' ELSE 'Title ' || k END AS title,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 53 = 0 THEN ' '
         WHEN k % 9 = 0 THEN c_name || ', Guest Director' ELSE c_name END AS director,
    CASE WHEN k % 11 = 0 THEN NULL ELSE c_mktsegment || ' Cast, Extra' END AS "cast",
    CASE WHEN k % 12 = 0 THEN NULL WHEN k % 2003 = 0 THEN 'Rareland'
         ELSE n_name || ', ' || r_name END AS country,
    CASE WHEN k % 89 = 0 THEN NULL WHEN k % 101 = 0 THEN 'not a date'
         ELSE (CASE WHEN k % 7 = 0 THEN ' ' ELSE '' END) || strftime(d, '%B') || ' '
              || day(d) || ', ' || (year(d) + 20) END AS date_added,
    CASE WHEN k % 97 = 0 THEN NULL ELSE CAST(year(d) + 20 - k % 30 AS INTEGER) END
      AS release_year,
    CASE k % 17 WHEN 0 THEN 'TV-MA' WHEN 1 THEN 'tv-ma ' WHEN 2 THEN 'TV-14' WHEN 3 THEN 'PG-13'
      WHEN 4 THEN 'R' WHEN 5 THEN 'TV-PG' WHEN 6 THEN 'PG' WHEN 7 THEN 'TV-Y7'
      WHEN 8 THEN 'TV-Y7-FV' WHEN 9 THEN 'TV-Y' WHEN 10 THEN 'TV-G' WHEN 11 THEN 'G'
      WHEN 12 THEN 'NR' WHEN 13 THEN 'UR' WHEN 14 THEN 'NC-17' WHEN 15 THEN '66 min' END
      AS rating,
    CASE WHEN k % 103 = 0 THEN NULL WHEN k % 107 = 0 THEN 'n/a'
         WHEN k % 10 < 7 THEN (60 + k % 90) || ' min' ELSE (1 + k % 9) || ' Season' END
      AS duration,
    CASE WHEN k % 67 = 0 THEN NULL WHEN k % 3001 = 0 THEN 'Rare Genre'
         ELSE 'Genre ' || ((k % 23) * (k % 23) % 23) || ', Other' END AS listed_in,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'About ' || o_orderpriority END AS description
  FROM base
),
bronze AS (
  SELECT * EXCLUDE (k) FROM single_titles
  UNION ALL
  SELECT * EXCLUDE (k) FROM single_titles WHERE k % 61 = 0
  UNION ALL
  SELECT * EXCLUDE (k) REPLACE (title || ' (again)' AS title, 'R' AS rating,
    release_year - 1 AS release_year)
  FROM single_titles WHERE k % 61 = 0
)"""


def _defaulted(column: str, default: str, out: str | None = None) -> str:
    quoted = f'"{column}"'
    blank = _BLANK.format(quoted)
    return f"CASE WHEN {blank} THEN '{default}' ELSE trim({quoted}) END AS {out or column}"


_SILVER = f"""
valid AS (
  SELECT * FROM bronze
  WHERE NOT {_BLANK.format("show_id")} AND NOT {_BLANK.format("title")}
),
unique_titles AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY show_id
  ORDER BY title NULLS FIRST, date_added NULLS FIRST, release_year NULLS FIRST) = 1),
clean AS (
  SELECT show_id, trim("type") AS content_type, title,
    {_defaulted("director", "Unknown")},
    {_defaulted("cast", "Not Available", "cast_and_crew")},
    {_defaulted("country", "Unknown")},
    CAST(try_strptime(trim(date_added), '%B %d, %Y') AS DATE) AS date_added,
    release_year,
    upper(CASE WHEN {_BLANK.format("rating")} THEN 'UNRATED' ELSE trim(rating) END) AS rating,
    duration,
    {_defaulted("listed_in", "Uncategorized", "genre")},
    {_defaulted("description", "No description available")},
    TRY_CAST(regexp_extract(duration, '(\\d+)', 1) AS INTEGER) AS duration_value,
    CASE WHEN lower(duration) LIKE '%min%' THEN 'minutes'
         WHEN lower(duration) LIKE '%season%' THEN 'seasons' ELSE 'unknown' END AS duration_unit
  FROM unique_titles
),
features AS (
  SELECT *,
    CAST(year(date_added) AS INTEGER) AS added_year,
    CAST(month(date_added) AS INTEGER) AS added_month,
    CAST(2026 - release_year AS INTEGER) AS content_age_years,
    CASE WHEN genre <> 'Uncategorized' THEN trim(split_part(genre, ',', 1))
         ELSE 'Uncategorized' END AS primary_genre,
    CASE WHEN country <> 'Unknown' THEN trim(split_part(country, ',', 1))
         ELSE 'Unknown' END AS primary_country,
    director <> 'Unknown' AS has_director,
    cast_and_crew <> 'Not Available' AS has_cast
  FROM clean
),
silver AS (
  SELECT *,
    coalesce(content_age_years <= 5, FALSE) AS is_recent,
    CAST(CAST(has_director AS INT) + CAST(has_cast AS INT)
      + CAST(duration_value IS NOT NULL AS INT) + CAST(date_added IS NOT NULL AS INT)
      + CAST(release_year IS NOT NULL AS INT) AS DOUBLE) / 5.0 AS data_quality_score
  FROM features
)"""

# Decimals add without error, and this takes the score as it is.
_SCORE = "round(avg(CAST(data_quality_score AS DECIMAL(12, 9))), 3)"
_AGE = f"round({sql_avg('content_age_years')}, 1)"
_DURATION = f"round({sql_avg('duration_value')}, 1)"
_TYPE_SHARE = (
    f"round({sql_percent('content_count', 'sum(content_count) OVER (PARTITION BY content_type)')}"
    ", 2) AS percentage_of_type"
)
_DISTINCT = "count(DISTINCT show_id)"
_MONTHS = " ".join(
    f"WHEN {i} THEN '{m}'"
    for i, m in enumerate(
        "January February March April May June July August September October November "
        "December".split(),
        start=1,
    )
)

GOLD_SQL = {
    "content_overview": f"""
  SELECT *,
    round({sql_percent("total_movies", "total_content_count")}, 2) AS movie_percentage,
    round({sql_percent("total_tv_shows", "total_content_count")}, 2) AS tv_show_percentage,
    round({sql_percent("high_quality_content_count", "total_content_count")}, 2)
      AS high_quality_percentage,
    round({sql_percent("content_with_director", "total_content_count")}, 2)
      AS director_completeness_pct
  FROM (
    SELECT DATE '2026-02-09' AS report_date,
      {_DISTINCT} AS total_content_count,
      count(DISTINCT CASE WHEN content_type = 'Movie' THEN show_id END) AS total_movies,
      count(DISTINCT CASE WHEN content_type = 'TV Show' THEN show_id END) AS total_tv_shows,
      {_SCORE} AS avg_quality_score,
      {sql_count("data_quality_score >= 0.8")} AS high_quality_content_count,
      {sql_count("has_director")} AS content_with_director,
      {sql_count("has_cast")} AS content_with_cast,
      {sql_count("is_recent")} AS recent_content_count,
      min(date_added) AS earliest_content_added, max(date_added) AS latest_content_added,
      min(release_year) AS oldest_release_year, max(release_year) AS newest_release_year,
      {_AGE} AS avg_content_age_years,
      count(DISTINCT primary_country) AS unique_countries,
      count(DISTINCT primary_genre) AS unique_genres
    FROM silver)""",
    "genre_analysis": f"""
  SELECT *, {_TYPE_SHARE} FROM (
    SELECT primary_genre, content_type, {_DISTINCT} AS content_count,
      {_SCORE} AS avg_quality_score,
      min(release_year) AS earliest_release_year, max(release_year) AS latest_release_year,
      {_AGE} AS avg_content_age_years,
      {sql_count("is_recent")} AS recent_content_count,
      {sql_count("added_year >= 2020")} AS added_since_2020,
      {_DURATION} AS avg_duration_value,
      round({sql_share("has_director")}, 2) AS director_completeness_pct,
      round({sql_share("has_cast")}, 2) AS cast_completeness_pct
    FROM silver WHERE primary_genre <> 'Uncategorized'
    GROUP BY primary_genre, content_type HAVING {_DISTINCT} >= 5)""",
    "geographic_distribution": f"""
  SELECT g.*, round({sql_percent("content_count", "total")}, 2) AS percentage_of_country
  FROM country_groups g JOIN (
    SELECT primary_country AS pc, sum(content_count) AS total FROM country_groups GROUP BY 1
  ) ON primary_country = pc""",
    "temporal_trends": f"""
  SELECT *, CASE added_month {_MONTHS} END AS month_name,
    CAST(sum(content_added_count) OVER (PARTITION BY content_type
      ORDER BY added_year, added_month ROWS UNBOUNDED PRECEDING) AS BIGINT)
      AS cumulative_content_count
  FROM (
    SELECT added_year, added_month, content_type, {_DISTINCT} AS content_added_count,
      {_SCORE} AS avg_quality_score, {_AGE} AS avg_age_of_content_added
    FROM silver WHERE date_added IS NOT NULL
    GROUP BY added_year, added_month, content_type)""",
    "rating_distribution": f"""
  SELECT *,
    CASE WHEN rating IN ('G', 'TV-Y', 'TV-G') THEN 'Kids & Family'
         WHEN rating IN ('PG', 'TV-PG', 'TV-Y7', 'TV-Y7-FV') THEN 'Older Kids & Teens'
         WHEN rating IN ('PG-13', 'TV-14') THEN 'Teens & Adults'
         WHEN rating IN ('R', 'TV-MA', 'NC-17') THEN 'Mature Audiences'
         WHEN rating IN ('NR', 'UNRATED', 'UR') THEN 'Unrated' ELSE 'Other' END
      AS rating_category,
    {_TYPE_SHARE}
  FROM (
    SELECT rating, content_type, {_DISTINCT} AS content_count, {_SCORE} AS avg_quality_score,
      {sql_count("is_recent")} AS recent_content_count, {_AGE} AS avg_content_age_years,
      {_DURATION} AS avg_duration_value
    FROM silver WHERE rating IS NOT NULL GROUP BY rating, content_type)""",
    "quality_scorecard": f"""
  SELECT q.*, sample_titles, {_TYPE_SHARE}
  FROM (
    SELECT content_type, quality_tier, {_DISTINCT} AS content_count,
      {_SCORE} AS avg_quality_score,
      round({sql_share("has_director")}, 2) AS has_director_pct,
      round({sql_share("has_cast")}, 2) AS has_cast_pct,
      {sql_count("duration_value IS NOT NULL")} AS has_duration_count,
      {sql_count("date_added IS NOT NULL")} AS has_date_added_count,
      {sql_count("release_year IS NOT NULL")} AS has_release_year_count
    FROM tiered GROUP BY content_type, quality_tier) q
  LEFT JOIN samples USING (content_type, quality_tier)""",
    "top_producers": f"""
  SELECT * FROM (
    SELECT *, CAST(latest_release_year - first_release_year AS INTEGER) AS years_active,
      CAST(row_number() OVER (PARTITION BY content_type
        ORDER BY content_count DESC, avg_quality_score DESC, director) AS INTEGER)
        AS rank_by_volume
    FROM (
      SELECT director, content_type, {_DISTINCT} AS content_count,
        {_SCORE} AS avg_quality_score,
        list_sort(list(DISTINCT primary_genre)) AS genres_worked_in,
        min(release_year) AS first_release_year, max(release_year) AS latest_release_year,
        {sql_count("is_recent")} AS recent_works_count
      FROM silver WHERE director <> 'Unknown' AND director NOT LIKE '%,%'
      GROUP BY director, content_type HAVING {_DISTINCT} >= 2))
  WHERE rank_by_volume <= 100""",
}

_HELPERS = {
    "geographic_distribution": f"""
country_groups AS (
  SELECT primary_country, content_type, {_DISTINCT} AS content_count,
    count(DISTINCT CASE WHEN content_type = 'Movie' THEN show_id END) AS movie_count,
    count(DISTINCT CASE WHEN content_type = 'TV Show' THEN show_id END) AS tv_show_count,
    {_SCORE} AS avg_quality_score,
    {sql_count("added_year = 2021")} AS added_2021,
    {sql_count("added_year = 2020")} AS added_2020,
    {sql_count("added_year = 2019")} AS added_2019,
    {sql_count("is_recent")} AS recent_content_count,
    {_AGE} AS avg_content_age_years
  FROM silver WHERE primary_country <> 'Unknown'
  GROUP BY primary_country, content_type HAVING {_DISTINCT} >= 10
)""",
    "quality_scorecard": """
tiered AS (
  SELECT *, CASE WHEN data_quality_score >= 0.9 THEN 'Excellent (0.9-1.0)'
    WHEN data_quality_score >= 0.7 THEN 'Good (0.7-0.89)'
    WHEN data_quality_score >= 0.5 THEN 'Fair (0.5-0.69)' ELSE 'Poor (<0.5)' END AS quality_tier
  FROM silver
),
samples AS (
  SELECT content_type, quality_tier, list(title ORDER BY title, show_id) AS sample_titles
  FROM (SELECT *, row_number() OVER (PARTITION BY content_type, quality_tier
          ORDER BY title, show_id) AS rn FROM tiered)
  WHERE rn <= 5 GROUP BY 1, 2
)""",
}


def sql_on_bronze(select: str) -> str:
    return f"WITH {_BRONZE}\n{select}"


def sql_on_silver(select: str) -> str:
    return f"WITH {_BRONZE},{_SILVER}\n{select}"


def sql_on_tiers(select: str) -> str:
    return f"WITH {_BRONZE},{_SILVER},{_HELPERS['quality_scorecard']}\n{select}"


def sql_on_gold(names: str | list[str], select: str) -> str:
    """``select`` may read each named gold table under its name."""
    names = [names] if isinstance(names, str) else names
    parts = [_BRONZE, _SILVER]
    for name in names:
        if name in _HELPERS:
            parts.append(_HELPERS[name])
        parts.append(f"\n{name} AS ({GOLD_SQL[name]}\n)")
    return f"WITH {','.join(parts)}\n{select}"
