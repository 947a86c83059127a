"""Every constant of the business rules, as overridable dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# The labels, thresholds and lists below must match the published outputs.
MOVIE = "Movie"
TV_SHOW = "TV Show"

UNKNOWN = "Unknown"
NOT_AVAILABLE = "Not Available"
UNRATED = "UNRATED"
UNCATEGORIZED = "Uncategorized"

REJECTION_REASON = "Missing required fields: show_id or title"

COLUMN_RENAMES = {"type": "content_type", "listed_in": "genre", "cast": "cast_and_crew"}

DATE_FORMATS = ("MMMM d, yyyy", "MMMM dd, yyyy")

MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

VALID_RATINGS = (
    "TV-MA", "TV-14", "TV-PG", "R", "PG-13", "TV-Y7", "TV-Y", "PG", "G",
    "NC-17", "NR", "TV-G", "TV-Y7-FV", "UR", "UNRATED",
)

RATING_CATEGORIES = (
    ("Kids & Family", ("G", "TV-Y", "TV-G")),
    ("Older Kids & Teens", ("PG", "TV-PG", "TV-Y7", "TV-Y7-FV")),
    ("Teens & Adults", ("PG-13", "TV-14")),
    ("Mature Audiences", ("R", "TV-MA", "NC-17")),
    ("Unrated", ("NR", "UNRATED", "UR")),
)
OTHER_CATEGORY = "Other"

QUALITY_TIERS = (
    ("Excellent (0.9-1.0)", 0.9),
    ("Good (0.7-0.89)", 0.7),
    ("Fair (0.5-0.69)", 0.5),
)
LOWEST_TIER = "Poor (<0.5)"

# Texts that a pandas CSV reader takes as missing by default (public pandas documentation).
PANDAS_NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# End of fixed values.


# Which of the rows of a key counts as its first: files have no order of their own.
DEDUPE_ORDER = ("title", "date_added", "release_year")


@dataclass(frozen=True)
class SilverRules:
    """Rules of the standard bronze-to-silver profile."""

    key: str = "show_id"
    required: tuple[str, ...] = ("show_id", "title")
    # Columns (renamed ones), nulls first, that decide which row of a repeated key is kept.
    dedupe_order: tuple[str, ...] = DEDUPE_ORDER
    rejection_reason: str = REJECTION_REASON
    # Identical rejects are all kept; True leaves one of each, as a set difference would.
    distinct_rejects: bool = False
    null_defaults: dict[str, str] = field(
        default_factory=lambda: {
            "director": UNKNOWN,
            "cast_and_crew": NOT_AVAILABLE,
            "country": UNKNOWN,
            "rating": UNRATED,
            "genre": UNCATEGORIZED,
            "description": "No description available",
        }
    )
    date_formats: tuple[str, ...] = DATE_FORMATS
    as_of_year: int = 2026
    recent_max_age: int = 5
    score_points: int = 5
    # None stamps rows with the clock; a timestamp text makes the run reproducible.
    processed_at: str | None = None


@dataclass(frozen=True)
class StrictRules:
    """Rules of the strict profile: no nulls survive, ratings come from an allow-list."""

    key: str = "show_id"
    required: tuple[str, ...] = ("show_id", "title")
    # Columns (renamed ones), nulls first, that decide which row of a repeated key is kept.
    dedupe_order: tuple[str, ...] = DEDUPE_ORDER
    null_defaults: dict[str, str] = field(
        default_factory=lambda: {
            "director": UNKNOWN,
            "cast_and_crew": NOT_AVAILABLE,
            "country": UNKNOWN,
            "genre": UNCATEGORIZED,
            "description": "No Description Available",
        }
    )
    ratings: tuple[str, ...] = VALID_RATINGS
    other_rating: str = "UR"
    date_formats: tuple[str, ...] = ("MMMM d, yyyy",)
    missing_date: str = "1900-01-01"
    missing_number: int = 0
    processed_at: str | None = None


@dataclass(frozen=True)
class GoldRules:
    """Thresholds and labels of the seven gold tables."""

    high_quality_min: float = 0.8
    tiers: tuple[tuple[str, float], ...] = QUALITY_TIERS
    lowest_tier: str = LOWEST_TIER
    rating_categories: tuple[tuple[str, tuple[str, ...]], ...] = RATING_CATEGORIES
    other_category: str = OTHER_CATEGORY
    genre_min_titles: int = 5
    country_min_titles: int = 10
    director_min_titles: int = 2
    producer_max_rank: int = 100
    sample_titles: int = 5
    added_years: tuple[int, ...] = (2021, 2020, 2019)
    since_year: int = 2020
    score_points: int = 5
    # None takes the current date; a date text makes the run reproducible.
    report_date: str | None = None

    @property
    def tier_order(self) -> tuple[str, ...]:
        return tuple(label for label, _ in self.tiers) + (self.lowest_tier,)
