"""Date parsing and calendar features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.config import MONTH_NAMES


def parse_date(text: Column, formats: Iterable[str]) -> Column:
    """First format that fits, else null; safe under ANSI mode."""
    return F.coalesce(*(F.try_to_date(text, f) for f in formats))


def fill_date(date: Column, sentinel: str) -> Column:
    return F.coalesce(date, F.to_date(F.lit(sentinel)))


def age_in_years(release_year: str, as_of_year: int) -> Column:
    return F.lit(as_of_year) - F.col(release_year)


def month_name(month: str) -> Column:
    """English month name of 1..12; anything else gives null."""
    return F.get(F.array(*(F.lit(m) for m in MONTH_NAMES)), F.col(month) - 1)


def first_of_month(year: str, month: str) -> Column:
    return F.make_date(F.col(year), F.col(month), F.lit(1))


def month_label(name: str, year: str) -> Column:
    return F.concat_ws(" ", F.col(name), F.col(year).cast("string"))


def processed_at(fixed: str | None) -> Column:
    return F.current_timestamp() if fixed is None else F.to_timestamp(F.lit(fixed))


def run_date(fixed: str | None) -> Column:
    return F.current_date() if fixed is None else F.to_date(F.lit(fixed))
