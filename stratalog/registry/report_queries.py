"""The report queries over gold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stratalog.config import VALID_RATINGS
from stratalog.plans.reports import (
    genre,
    geography,
    overview,
    producers,
    quality,
    rating,
    temporal,
)
from stratalog.registry.base import ORDER_YEARS, on_gold, register, sql_mean, sql_on_gold, sql_text
from stratalog.sources.sinks import render_arrays


def _subject(gold_name: str):
    def report(name: str, plan: Callable[[DataFrame], DataFrame], select: str) -> None:
        register(name, on_gold(gold_name, plan), sql_on_gold(gold_name, select))

    return report


# ---------------------------------------------------------------------------------- overview
_report = _subject("content_overview")
_report(
    "l01_headline_kpis",
    overview.headline_kpis,
    """SELECT total_content_count, total_movies, movie_percentage, total_tv_shows,
  tv_show_percentage, avg_quality_score, unique_countries, unique_genres, avg_content_age_years
FROM content_overview""",
)
_report(
    "l02_content_type_shares",
    overview.content_type_shares,
    """SELECT 'Movies' AS "type", total_movies AS "count", movie_percentage AS percentage
FROM content_overview
UNION ALL
SELECT 'TV Shows', total_tv_shows, tv_show_percentage FROM content_overview""",
)
_report(
    "l03_field_completeness",
    overview.field_completeness,
    """SELECT 'Director' AS field, director_completeness_pct AS completeness FROM content_overview
UNION ALL
SELECT 'Cast', CAST(content_with_cast AS DOUBLE) / total_content_count * 100
FROM content_overview""",
)
_report(
    "l04_quality_split",
    overview.quality_split,
    """SELECT 'High Quality' AS category, high_quality_content_count AS "count"
FROM content_overview
UNION ALL
SELECT 'Lower Quality', total_content_count - high_quality_content_count
FROM content_overview""",
)
_report(
    "l05_summary_table",
    overview.summary_table,
    """SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS "position",
  unnest(['Total Content', 'Movies', 'TV Shows', 'High Quality Content',
    'Countries Represented', 'Genres Available', 'Average Quality Score',
    'Director Completeness', 'Average Content Age']) AS metric,
  unnest([format('{:,}', total_content_count),
    format('{:,} ({:.1f}%)', total_movies, round(movie_percentage, 1)),
    format('{:,} ({:.1f}%)', total_tv_shows, round(tv_show_percentage, 1)),
    format('{:,} ({:.1f}%)', high_quality_content_count, round(high_quality_percentage, 1)),
    CAST(unique_countries AS VARCHAR), CAST(unique_genres AS VARCHAR),
    format('{:.1f}%', round(avg_quality_score * 100, 1)),
    format('{:.1f}%', round(director_completeness_pct, 1)),
    format('{:.1f} years', avg_content_age_years)]) AS "value"
FROM content_overview""",
)

# ------------------------------------------------------------------------------------- genre
_report = _subject("genre_analysis")
_report(
    "l06_top_genres_by_count",
    genre.top_by_count,
    """SELECT primary_genre, content_type, content_count, avg_quality_score FROM genre_analysis
ORDER BY content_count DESC, primary_genre, content_type LIMIT 10""",
)
_report(
    "l07_top_genres_by_score",
    genre.top_by_score,
    """SELECT primary_genre, content_type, avg_quality_score FROM genre_analysis
ORDER BY avg_quality_score DESC, primary_genre, content_type LIMIT 10""",
)
_report(
    "l08_top_genres_by_duration",
    genre.top_by_duration,
    """SELECT primary_genre, content_type, avg_duration_value FROM genre_analysis
WHERE avg_duration_value > 0
ORDER BY avg_duration_value DESC, primary_genre, content_type LIMIT 10""",
)
_report(
    "l09_top_genres_over_types",
    genre.top_over_types,
    """SELECT primary_genre, CAST(sum(content_count) AS BIGINT) AS total FROM genre_analysis
GROUP BY primary_genre ORDER BY total DESC, primary_genre LIMIT 10""",
)
_report(
    "l09_genre_table",
    genre.table,
    """SELECT primary_genre, content_type, content_count, avg_quality_score,
  earliest_release_year, latest_release_year FROM genre_analysis""",
)

# --------------------------------------------------------------------------------- geography
_report = _subject("geographic_distribution")
_COUNT = "CAST(sum(content_count) AS BIGINT) AS content_count"
_SCORE = f"{sql_mean('avg_quality_score', 3)} AS avg_quality_score"
_GEO = "FROM geographic_distribution WHERE content_count >= 10"
_report(
    "l11_geography_kpis",
    geography.kpis,
    f"""SELECT
  (SELECT count(DISTINCT primary_country) FROM geographic_distribution) AS total_countries,
  top.primary_country AS top_country, top.titles AS top_country_titles, chosen.*
FROM (SELECT primary_country, CAST(sum(content_count) AS BIGINT) AS titles
      FROM geographic_distribution GROUP BY 1
      ORDER BY titles DESC, primary_country LIMIT 1) top,
  (SELECT {_SCORE}, CAST(sum(added_2021) AS BIGINT) AS added_2021 {_GEO}) chosen""",
)
_report(
    "l12_top_countries",
    geography.top_countries,
    f"""SELECT primary_country, {_COUNT}, {_SCORE} {_GEO} GROUP BY primary_country
ORDER BY content_count DESC, primary_country LIMIT 15""",
)
_report(
    "l12_top_countries_weighted",
    lambda df: geography.top_countries(df, weighted=True),
    f"""SELECT primary_country, {_COUNT},
  CAST(sum(content_count * CAST(round(avg_quality_score * 1000) AS BIGINT)) AS DOUBLE)
    / (CAST(sum(content_count) AS DOUBLE) * 1000) AS avg_quality_score
{_GEO} GROUP BY primary_country ORDER BY content_count DESC, primary_country LIMIT 15""",
)
_report(
    "l13_country_type_split",
    geography.type_split,
    f"""SELECT primary_country, content_type, content_count {_GEO}
  AND primary_country IN (SELECT primary_country {_GEO} GROUP BY primary_country
    ORDER BY sum(content_count) DESC, primary_country LIMIT 10)
ORDER BY content_count DESC, primary_country, content_type LIMIT 20""",
)
_report(
    "l14_movie_share_by_country",
    geography.movie_share,
    f"""SELECT *, CAST(movie_count AS DOUBLE) / content_count * 100 AS movie_pct FROM (
  SELECT primary_country, CAST(sum(movie_count) AS BIGINT) AS movie_count,
    CAST(sum(tv_show_count) AS BIGINT) AS tv_show_count, {_COUNT} {_GEO}
  GROUP BY primary_country ORDER BY content_count DESC, primary_country LIMIT 10)""",
)
_report(
    "l15_top_countries_by_score",
    geography.top_by_score,
    f"""SELECT primary_country, {_COUNT}, {_SCORE} {_GEO} AND content_count >= 20
GROUP BY primary_country ORDER BY avg_quality_score DESC, primary_country LIMIT 15""",
)
_report(
    "l16_volume_and_score",
    geography.volume_and_score,
    f"SELECT primary_country, {_COUNT}, {_SCORE} {_GEO} GROUP BY primary_country",
)
_report(
    "l17_additions_by_year",
    geography.additions_by_year,
    f"""SELECT primary_country, unnest(['2019', '2020', '2021']) AS "year",
  unnest([a19, a20, a21]) AS content_added
FROM (SELECT primary_country, CAST(sum(added_2019) AS BIGINT) AS a19,
    CAST(sum(added_2020) AS BIGINT) AS a20, CAST(sum(added_2021) AS BIGINT) AS a21
  {_GEO} GROUP BY primary_country ORDER BY sum(content_count) DESC, primary_country LIMIT 10)""",
)
_AGE = f"{sql_mean('avg_content_age_years', 1)} AS avg_content_age_years"
_report(
    "l18_mean_age_by_country",
    geography.mean_age,
    f"""SELECT primary_country, {_AGE}, {_COUNT} {_GEO} GROUP BY primary_country
ORDER BY content_count DESC, primary_country LIMIT 15""",
)
_report(
    "l19_country_table",
    geography.table,
    f"""SELECT primary_country AS "Country", CAST(sum(content_count) AS BIGINT) AS "Total Content",
  CAST(sum(movie_count) AS BIGINT) AS "Movies", CAST(sum(tv_show_count) AS BIGINT) AS "TV Shows",
  {sql_mean("avg_quality_score", 3)} AS "Avg Quality",
  CAST(sum(added_2021) AS BIGINT) AS "Added 2021",
  {sql_mean("avg_content_age_years", 1)} AS "Avg Age (Years)"
{_GEO} GROUP BY primary_country""",
)

# ------------------------------------------------------------------------------------ rating
_report = _subject("rating_distribution")
_RATED = "FROM rating_distribution WHERE rating IN ({})".format(
    ", ".join(f"'{rating_}'" for rating_ in VALID_RATINGS)
)
_report(
    "l20_rating_kpis",
    rating.kpis,
    f"""SELECT figures.*, top.rating AS top_rating, top.titles AS top_rating_titles
FROM (SELECT count(DISTINCT rating) AS unique_ratings,
    CAST(sum(content_count) FILTER (WHERE rating_category = 'Mature Audiences') AS DOUBLE)
      / sum(content_count) * 100 AS mature_pct,
    CAST(sum(content_count) FILTER (WHERE rating_category = 'Mature Audiences') AS BIGINT)
      AS mature_titles,
    {_SCORE} {_RATED}) figures,
  (SELECT rating, CAST(sum(content_count) AS BIGINT) AS titles {_RATED}
   GROUP BY rating ORDER BY titles DESC, rating LIMIT 1) top""",
)
_report(
    "l21_top_ratings",
    rating.top_ratings,
    f"""SELECT rating, {_COUNT}, min(rating_category) AS rating_category {_RATED}
GROUP BY rating ORDER BY content_count DESC, rating LIMIT 10""",
)
_report(
    "l21_top_rating_counts",
    rating.top_rating_counts,
    f"SELECT rating, {_COUNT} {_RATED} GROUP BY rating ORDER BY content_count DESC, rating LIMIT 8",
)
_report(
    "l22_category_breakdown",
    rating.category_breakdown,
    f"SELECT rating_category, {_COUNT}, {_SCORE} {_RATED} GROUP BY rating_category",
)
_report(
    "l23_rating_type_split",
    rating.type_split,
    f"""SELECT rating, content_type, content_count {_RATED}
  AND rating IN (SELECT rating {_RATED} GROUP BY rating
    ORDER BY sum(content_count) DESC, rating LIMIT 10)
ORDER BY content_count DESC, rating, content_type LIMIT 20""",
)
_report(
    "l24_mean_duration_by_rating",
    rating.mean_duration,
    f"""SELECT rating, {sql_mean("avg_duration_value", 1)} AS avg_duration_value, {_COUNT}
{_RATED} AND avg_duration_value IS NOT NULL
GROUP BY rating ORDER BY content_count DESC, rating LIMIT 10""",
)
_report(
    "l25_mean_age_by_rating",
    rating.mean_age,
    f"""SELECT rating, {_AGE}, {_COUNT} {_RATED} AND avg_content_age_years IS NOT NULL
GROUP BY rating ORDER BY content_count DESC, rating LIMIT 10""",
)
_report(
    "l26_recent_share_by_rating",
    rating.recent_share,
    f"""SELECT *, CAST(recent_content_count AS DOUBLE) / content_count * 100 AS recent_percentage
FROM (SELECT rating, CAST(sum(recent_content_count) AS BIGINT) AS recent_content_count, {_COUNT}
  {_RATED} GROUP BY rating ORDER BY content_count DESC, rating LIMIT 15)""",
)
_report(
    "l27_rating_table",
    rating.table,
    f"""SELECT rating AS "Rating", rating_category AS "Category", content_type AS "Type",
  CAST(sum(content_count) AS BIGINT) AS "Count",
  {sql_mean("percentage_of_type", 2)} AS "Type %",
  {sql_mean("avg_quality_score", 3)} AS "Quality",
  CAST(sum(recent_content_count) AS BIGINT) AS "Recent",
  {sql_mean("avg_content_age_years", 1)} AS "Age (Y)",
  {sql_mean("avg_duration_value", 1)} AS "Duration"
{_RATED} GROUP BY rating, rating_category, content_type""",
)

# ---------------------------------------------------------------------------------- temporal
_report = _subject("temporal_trends")
_MONTH = "make_date(added_year, added_month, 1)"
_ADDED = "CAST(sum(content_added_count) AS BIGINT) AS content_added_count"
_report(
    "l28_temporal_kpis",
    temporal.kpis,
    f"""SELECT figures.*, peak_month, peak_month_titles, avg_monthly_additions
FROM (SELECT CAST(sum(content_added_count) AS BIGINT) AS total_added, {_SCORE}
      FROM temporal_trends) figures,
  (SELECT month_name || ' ' || added_year AS peak_month,
     content_added_count AS peak_month_titles
   FROM temporal_trends
   ORDER BY content_added_count DESC, added_year, added_month, content_type LIMIT 1) peak,
  (SELECT CAST(sum(n) AS DOUBLE) / count(*) AS avg_monthly_additions
   FROM (SELECT sum(content_added_count) AS n FROM temporal_trends
         GROUP BY added_year, added_month)) monthly""",
)
_report(
    "l29_monthly_timeline",
    temporal.monthly_timeline,
    f"""SELECT {_MONTH} AS year_month, content_type, {_ADDED}
FROM temporal_trends GROUP BY 1, 2""",
)
_report(
    "l30_cumulative_growth",
    lambda df: temporal.cumulative_growth(df, first_year=2017, last_year=2020),
    f"""SELECT *, CAST(sum(content_added_count) OVER (PARTITION BY content_type
    ORDER BY year_month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_count
FROM (SELECT {_MONTH} AS year_month, content_type, {_ADDED}
  FROM temporal_trends WHERE added_year BETWEEN 2017 AND 2020 GROUP BY 1, 2)""",
)
_report(
    "l31_yearly_additions",
    temporal.yearly_additions,
    f"SELECT added_year, content_type, {_ADDED} FROM temporal_trends GROUP BY 1, 2",
)
_report(
    "l32_yearly_score",
    temporal.yearly_score,
    f"SELECT added_year, content_type, {_SCORE} FROM temporal_trends GROUP BY 1, 2",
)
_report(
    "l33_seasonality",
    temporal.seasonality,
    """SELECT added_month, month_name,
  CAST(sum(content_added_count) AS DOUBLE) / count(*) AS content_added_count
FROM temporal_trends GROUP BY 1, 2""",
)
_report(
    "l34_month_year_matrix",
    temporal.month_year_matrix,
    # Titles are added twenty years after their orders.
    "SELECT added_month, "
    + ", ".join(
        f'CAST(coalesce(sum(content_added_count) FILTER (WHERE added_year = {y + 20}), 0) AS BIGINT) AS "{y + 20}"'
        for y in ORDER_YEARS
    )
    + " FROM temporal_trends GROUP BY 1",
)
_report(
    "l35_age_at_addition",
    temporal.age_at_addition,
    f"""SELECT {_MONTH} AS year_month, content_type,
  {sql_mean("avg_age_of_content_added", 1)} AS avg_age_of_content_added
FROM temporal_trends GROUP BY 1, 2""",
)
_report(
    "l36_top_months",
    temporal.top_months,
    f"""SELECT added_year, added_month, month_name, {_ADDED}, {_SCORE},
  month_name || ' ' || added_year AS year_month_label
FROM temporal_trends GROUP BY added_year, added_month, month_name
ORDER BY content_added_count DESC, added_year, added_month LIMIT 20""",
)
_report(
    "l37_temporal_table",
    temporal.table,
    f"""SELECT added_year AS "Year", added_month AS "Month #", month_name AS "Month",
  content_type AS "Type", CAST(sum(content_added_count) AS BIGINT) AS "Added",
  max(cumulative_content_count) AS "Cumulative",
  {sql_mean("avg_quality_score", 3)} AS "Quality",
  {sql_mean("avg_age_of_content_added", 1)} AS "Avg Age"
FROM temporal_trends GROUP BY added_year, added_month, month_name, content_type
ORDER BY added_year DESC, added_month DESC, content_type LIMIT 100""",
)

# ----------------------------------------------------------------------------------- quality
_report = _subject("quality_scorecard")
_report(
    "l10_rows_per_tier",
    quality.rows_per_tier,
    "SELECT quality_tier, count(*) AS records FROM quality_scorecard GROUP BY quality_tier",
)


def _tier_sum(tier: str) -> str:
    return f"coalesce(sum(content_count) FILTER (WHERE quality_tier = '{tier}'), 0)"


_EXCELLENT, _GOOD = _tier_sum("Excellent (0.9-1.0)"), _tier_sum("Good (0.7-0.89)")
_report(
    "l38_quality_kpis",
    quality.kpis,
    f"""SELECT CAST({_EXCELLENT} AS DOUBLE) / sum(content_count) * 100 AS excellent_pct,
  CAST({_EXCELLENT} AS BIGINT) AS excellent_titles,
  CAST({_GOOD} AS DOUBLE) / sum(content_count) * 100 AS good_pct,
  CAST({_GOOD} AS BIGINT) AS good_titles, {_SCORE},
  {sql_mean("has_director_pct", 2)} AS avg_director_completeness
FROM quality_scorecard""",
)
_report(
    "l39_tier_totals",
    quality.tier_totals,
    f"SELECT quality_tier, {_COUNT} FROM quality_scorecard GROUP BY quality_tier",
)
_report(
    "l39_tier_type_totals",
    quality.tier_type_totals,
    f"SELECT content_type, quality_tier, {_COUNT} FROM quality_scorecard GROUP BY 1, 2",
)
_report(
    "l40_tier_scores",
    quality.tier_scores,
    f"SELECT quality_tier, {_SCORE}, {_COUNT} FROM quality_scorecard GROUP BY quality_tier",
)
_report(
    "l41_completeness_by_tier",
    quality.completeness_by_tier,
    f"""SELECT quality_tier, {sql_mean("has_director_pct", 2)} AS director_completeness,
  {sql_mean("has_cast_pct", 2)} AS cast_completeness
FROM quality_scorecard GROUP BY quality_tier""",
)
_FIELDS = {
    "Director": sql_mean("has_director_pct", 2),
    "Cast": sql_mean("has_cast_pct", 2),
    "Duration": "CAST(sum(has_duration_count) AS DOUBLE) / sum(content_count) * 100",
    "Date Added": "CAST(sum(has_date_added_count) AS DOUBLE) / sum(content_count) * 100",
    "Release Year": "CAST(sum(has_release_year_count) AS DOUBLE) / sum(content_count) * 100",
}
_report(
    "l42_field_matrix",
    quality.field_matrix,
    "SELECT field, "
    + ", ".join(f"max(v) FILTER (WHERE quality_tier = '{t}') AS \"{t}\"" for t in quality.TIER_ORDER)
    + " FROM ("
    + " UNION ALL ".join(
        f"SELECT quality_tier, '{field}' AS field, {value} AS v FROM quality_scorecard GROUP BY 1"
        for field, value in _FIELDS.items()
    )
    + ") GROUP BY field",
)
_WEIGHTED = """CAST(sum(content_count * CAST(round(avg_quality_score * 1000) AS BIGINT)) AS DOUBLE)
    / (CAST(sum(content_count) AS DOUBLE) * 1000) AS avg_quality_score"""
_report(
    "l43_type_tier_hierarchy",
    quality.type_tier_hierarchy,
    f"""SELECT content_type, quality_tier, {_COUNT}, {_WEIGHTED},
  CAST(2 - grouping(quality_tier) AS INTEGER) AS depth
FROM quality_scorecard GROUP BY GROUPING SETS ((content_type, quality_tier), (content_type))""",
)
_report(
    "l44_low_quality_rows",
    lambda df: render_arrays(quality.low_quality_rows(df)),
    f"""SELECT * REPLACE ({sql_text("sample_titles")} AS sample_titles) FROM quality_scorecard
WHERE quality_tier LIKE '%Poor%' OR quality_tier LIKE '%Fair%'""",
)
_report(
    "l45_scorecard_table",
    quality.table,
    """SELECT content_type AS "Type", quality_tier AS "Quality Tier", content_count AS "Count",
  percentage_of_type AS "Type %", avg_quality_score AS "Avg Score",
  has_director_pct AS "Director %", has_cast_pct AS "Cast %" FROM quality_scorecard""",
)

# --------------------------------------------------------------------------------- producers
_report = _subject("top_producers")
_MADE = "FROM top_producers WHERE content_count >= 3"
_report(
    "l46_producer_kpis",
    producers.kpis,
    f"""SELECT figures.*, top.director AS most_prolific, content_count AS most_prolific_titles
FROM (SELECT count(DISTINCT director) AS total_producers, {_SCORE},
    CAST(sum(years_active) AS DOUBLE) / count(years_active) AS avg_years_active {_MADE}) figures,
  (SELECT director, content_count {_MADE}
   ORDER BY content_count DESC, director, content_type LIMIT 1) top""",
)
_report(
    "l47_top_producers_by_count",
    producers.top_by_count,
    f"""SELECT director, content_type, content_count {_MADE}
ORDER BY content_count DESC, director, content_type LIMIT 20""",
)
_report(
    "l48_top_producers_by_score",
    producers.top_by_score,
    f"""SELECT director, content_type, content_count, avg_quality_score {_MADE}
  AND content_count >= 5 ORDER BY avg_quality_score DESC, director, content_type LIMIT 15""",
)
_report(
    "l49_productivity_and_score",
    producers.productivity_and_score,
    f"SELECT director, content_type, content_count, avg_quality_score {_MADE}",
)
_report(
    "l50_career_spans",
    producers.career_spans,
    f"""SELECT director, content_type, content_count, years_active {_MADE} AND years_active > 0
ORDER BY content_count DESC, director, content_type LIMIT 20""",
)
_report(
    "l51_career_timeline",
    producers.career_timeline,
    f"""SELECT director, content_type, content_count, first_release_year, latest_release_year
{_MADE} AND content_count >= 5
ORDER BY content_count DESC, director, content_type LIMIT 15""",
)
_GENRES = "CAST(len(genres_worked_in) AS INTEGER)"
_report(
    "l52_genre_diversity",
    producers.genre_diversity,
    f"""SELECT director, content_type, content_count, {_GENRES} AS genre_count {_MADE}
  AND content_count >= 5 ORDER BY genre_count DESC, director, content_type LIMIT 15""",
)
_report(
    "l53_producer_types",
    producers.producer_types,
    f"""SELECT CASE WHEN {_GENRES} <= 2 THEN 'Specialist (1-2)'
    WHEN {_GENRES} <= 4 THEN 'Moderate (3-4)' ELSE 'Generalist (5+)' END AS producer_type, {_COUNT}
{_MADE} GROUP BY 1""",
)
_report(
    "l54_recently_active",
    producers.recently_active,
    f"""SELECT director, content_type, recent_works_count {_MADE} AND recent_works_count > 0
ORDER BY recent_works_count DESC, director, content_type LIMIT 20""",
)
_report(
    "l55_producer_search",
    lambda df: render_arrays(producers.search(df, "MER#00000001")),
    f"""SELECT * REPLACE ({sql_text("genres_worked_in")} AS genres_worked_in) {_MADE} AND lower(director) LIKE '%mer#00000001%'
ORDER BY content_type, rank_by_volume LIMIT 10""",
)
_report(
    "l56_producer_table",
    producers.table,
    f"""SELECT director AS "Director", content_type AS "Type", content_count AS "Content",
  avg_quality_score AS "Quality", first_release_year AS "First Year",
  latest_release_year AS "Latest Year", years_active AS "Years Active",
  recent_works_count AS "Recent", rank_by_volume AS "Rank" {_MADE}
ORDER BY content_count DESC, director, content_type LIMIT 100""",
)
