"""Bronze to silver: the standard and the strict cleansing profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.config import (
    COLUMN_RENAMES,
    NOT_AVAILABLE,
    UNCATEGORIZED,
    UNKNOWN,
    SilverRules,
    StrictRules,
)
from stratalog.functions import dates, duration, quality, text
from stratalog.operators import cleanse, rows
from stratalog.schema import SILVER_COLUMNS


def cleansed(df: DataFrame, rules: SilverRules) -> DataFrame:
    """Default the blanks, parse dates and durations, normalise texts."""
    clean = cleanse.standardise_blanks(df, rules.null_defaults)
    return clean.withColumns(
        {
            "date_added": dates.parse_date(F.trim("date_added"), rules.date_formats),
            "duration_value": duration.duration_value("duration"),
            "duration_unit": duration.duration_unit("duration"),
            "rating": text.upper_trim("rating"),
            "content_type": F.trim("content_type"),
        }
    )


def enriched(df: DataFrame, rules: SilverRules) -> DataFrame:
    """Add calendar features, primary values, flags and the completeness score."""
    features = df.withColumns(
        {
            "added_year": F.year("date_added"),
            "added_month": F.month("date_added"),
            "content_age_years": dates.age_in_years("release_year", rules.as_of_year),
            "primary_genre": text.primary_value("genre", UNCATEGORIZED),
            "primary_country": text.primary_value("country", UNKNOWN),
            "has_director": quality.is_known("director", UNKNOWN),
            "has_cast": quality.is_known("cast_and_crew", NOT_AVAILABLE),
        }
    )
    flags = [
        F.col("has_director"),
        F.col("has_cast"),
        F.col("duration_value").isNotNull(),
        F.col("date_added").isNotNull(),
        F.col("release_year").isNotNull(),
    ]
    return features.withColumns(
        {
            "is_recent": quality.is_recent("content_age_years", rules.recent_max_age),
            "data_quality_score": quality.completeness_score(flags, rules.score_points),
        }
    )


def silver(bronze: DataFrame, rules: SilverRules = SilverRules()) -> DataFrame:
    """Valid, unique, cleansed and enriched titles; one shuffle, by the key."""
    valid = cleanse.valid_rows(bronze, rules.required)
    order = [F.col(c) for c in rules.dedupe_order]
    unique = cleanse.dedupe(rows.rename(valid, COLUMN_RENAMES), [rules.key], order)
    full = enriched(cleansed(unique, rules), rules)
    stamped = full.withColumn("processed_timestamp", dates.processed_at(rules.processed_at))
    return stamped.select(*SILVER_COLUMNS)


def rejected(bronze: DataFrame, rules: SilverRules = SilverRules()) -> DataFrame:
    # Copies of a row are valid or rejected together, so they may be dropped after the filter.
    kept = cleanse.rejected_rows(
        bronze, rules.required, rules.rejection_reason, dates.processed_at(rules.processed_at)
    )
    return kept.distinct() if rules.distinct_rejects else kept


def strict_silver(bronze: DataFrame, rules: StrictRules = StrictRules()) -> DataFrame:
    """The profile without nulls: sentinels for dates and numbers, ratings from an allow-list."""
    renamed = rows.rename(bronze, COLUMN_RENAMES)
    unique = dedupe_then_drop(renamed, rules)
    filled = cleanse.fill_empty(unique, rules.null_defaults)
    number = F.regexp_extract("duration", r"(\d+)", 1)
    clean = filled.withColumns(
        {
            "rating": text.allow_listed("rating", rules.ratings, rules.other_rating),
            "date_added": dates.fill_date(
                dates.parse_date(text.strip_whitespace("date_added"), rules.date_formats),
                rules.missing_date,
            ),
            "release_year": duration.int_or(F.col("release_year"), rules.missing_number),
            "duration_value": duration.int_or(number, rules.missing_number),
            "duration_unit": duration.duration_unit("duration"),
            "description_length": F.length("description"),
        }
    )
    at = dates.processed_at(rules.processed_at)
    return clean.withColumns({"processing_date": at.cast("date"), "processed_timestamp": at})


def dedupe_then_drop(df: DataFrame, rules: StrictRules) -> DataFrame:
    """Dedupe first and drop incomplete rows after, in that order.

    Rows with a null key would all be dropped in the end, so they need not be shuffled; a null
    title may win its key and take the key's other rows along.
    """
    keyed = df.filter(F.col(rules.key).isNotNull())
    order = [F.col(c) for c in rules.dedupe_order]
    return rows.keep_not_null(cleanse.dedupe(keyed, [rules.key], order), rules.required)
