"""Text predicates and clean-up."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes, as a Java character class.
_STRIP_CLASS = r"[\s\x1c-\x1f]+"


def is_blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def all_present(names: Iterable[str]) -> Column:
    """True where every column is neither null nor blank, else false; never null."""
    return reduce(lambda a, b: a & b, (~is_blank(n) for n in names))


def all_not_null(names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))


def default_if_blank(name: str, default: str) -> Column:
    return F.when(is_blank(name), F.lit(default)).otherwise(F.trim(F.col(name)))


def default_if_empty(name: str, default: str) -> Column:
    """Only null and the exact empty text are replaced; blanks stay, nothing is trimmed."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def strip_whitespace(name: str) -> Column:
    """Strip every kind of Unicode white space at both ends, not only the space character."""
    return F.regexp_replace(F.col(name), f"(?U)^{_STRIP_CLASS}|{_STRIP_CLASS}$", "")


def upper_trim(name: str) -> Column:
    return F.upper(F.trim(F.col(name)))


def allow_listed(name: str, allowed: Iterable[str], other: str) -> Column:
    """The stripped value where the list holds it (case counts), else ``other``; null gives other."""
    stripped = strip_whitespace(name)
    return F.when(stripped.isin(*allowed), stripped).otherwise(F.lit(other))


def primary_value(name: str, sentinel: str, separator: str = ",") -> Column:
    """First element of a separated list, trimmed; null and the sentinel give the sentinel."""
    return F.when(
        F.col(name) != sentinel, F.trim(F.split_part(F.col(name), F.lit(separator), F.lit(1)))
    ).otherwise(F.lit(sentinel))


def contains_ignore_case(name: str, text: str) -> Column:
    """Literal substring test; null never matches."""
    return F.coalesce(F.lower(F.col(name)).contains(text.lower()), F.lit(False))


def matches_ignore_case(name: str, pattern: str) -> Column:
    """Regular-expression test for callers who search with patterns; null never matches."""
    return F.coalesce(F.col(name).rlike(f"(?iu){pattern}"), F.lit(False))


def null_tokens_to_null(name: str, tokens: Iterable[str]) -> Column:
    return F.when(F.col(name).isin(*tokens), F.lit(None)).otherwise(F.col(name))
