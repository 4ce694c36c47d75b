"""Text to typed columns. Text that cannot be read becomes NULL, never an error."""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.config import BLANK_KEYS, NULL_TOKENS

_YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_MONTH = ("(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|"
          "(?<=jun)e|(?<=jul)y|(?<=aug)ust|(?<=sep)t(?:ember)?|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?")
_DAY_NAME = rf"(?i)^(\d{{1,2}})[ -]{_MONTH}[ ,-]\s*(\d{{4}})$"
_NAME_DAY = rf"(?i)^{_MONTH} (\d{{1,2}}),?\s+(\d{{4}})$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def null_tokens(c: Column) -> Column:
    """NULL for the texts that mean "no value"."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def to_double(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), F.trim(c)).try_cast("double")


def to_whole(c: Column) -> Column:
    """Whole number, large ones exactly; text with a fraction other than zero gives NULL."""
    x = to_double(c)
    # Plain digits, nearly all texts, need no pattern.
    return F.coalesce(c.try_cast("bigint"), F.when(x == F.floor(x), x).try_cast("bigint"))


def currency(c: Column) -> Column:
    """``$300,385.62`` to 300385.62: all but digits, dot and minus is dropped.

    So ``(300)`` is plus 300, and a decimal comma is lost.
    """
    return to_double(F.regexp_replace(c, r"[^0-9.\-]", ""))


def tidy_label(c: Column) -> Column:
    """Outer whitespace off, inner runs of it to one blank."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(trimmed, r"(?U)\s+", " ")


def label_changed(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != F.coalesce(tidy_label(c), F.lit(""))


def date_component(c: Column, position: int) -> Column:
    """The n-th part (from 0) of a date text split at dashes and slashes, as int."""
    return F.get(F.split(c, "[-/]"), F.lit(position)).try_cast("int")


def mixed_date(c: Column, day_first: bool = False) -> Column:
    """Dates with slashes or dashes, year first (also with a time) or with an English month name.

    The order asked for is used whenever the month position can be a month;
    otherwise the other order is tried. The pattern is picked by the shape of
    the text first, so each row is parsed once; a time of day is dropped.
    """
    text = F.trim(c)
    first, second = date_component(text, 0), date_component(text, 1)
    month_first = (second > 12) | (first <= 12) if not day_first else (second > 12)
    slash = text.contains("/")

    def read(slashed: str, dashed: str) -> Column:
        return F.when(slash, F.try_to_date(text, slashed)).otherwise(F.try_to_date(text, dashed))

    named = F.initcap(F.regexp_replace(text, _DAY_NAME, "$1 $2 $3"))
    named_first = F.initcap(F.regexp_replace(text, _NAME_DAY, "$2 $1 $3"))
    return (
        F.when(text.rlike(_YEAR_FIRST), F.try_to_date(F.regexp_replace(text, _YEAR_FIRST, "$1-$3-$4"), "yyyy-M-d"))
        .when(text.rlike(_DAY_NAME), F.try_to_date(named, "d MMM yyyy"))
        .when(text.rlike(_NAME_DAY), F.try_to_date(named_first, "d MMM yyyy"))
        .when(~text.rlike(r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"), F.lit(None).cast("date"))
        .when(month_first, read("M/d/yyyy", "M-d-yyyy"))
        .otherwise(read("d/M/yyyy", "d-M-yyyy"))
    )


def month_first_date(c: Column) -> Column:
    """Fixed format month-day-year with dashes."""
    return F.when(c.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(c, "M-d-yyyy"))


def ambiguous_date(c: Column) -> Column:
    """True for a dashed date whose first two parts could both be the month."""
    parts = F.split(c, "[-/]")
    return F.coalesce(
        c.contains("-")
        & (F.size(parts) == 3)
        & (date_component(c, 0) <= 12)
        & (date_component(c, 1) <= 12),
        F.lit(False),
    )


def age_on(birth: Column, reference: dt.date) -> Column:
    """Whole years from ``birth`` to ``reference``."""
    later = (F.month(birth) > reference.month) | (
        (F.month(birth) == reference.month) & (F.dayofmonth(birth) > reference.day)
    )
    return (F.lit(reference.year) - F.year(birth) - later.cast("int")).cast("int")


def label_flag(c: Column, word: str) -> Column:
    """1 where the label equals ``word`` in any case, else 0 (also for NULL)."""
    return F.coalesce((F.lower(c) == word.lower()).cast("int"), F.lit(0))


def full_name(first: Column, last: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.concat(bare(first), F.lit(" "), bare(last))


def key_or_null(c: Column, blanks: Iterable[str] = BLANK_KEYS) -> Column:
    """Trimmed key, NULL for the texts that stand for a missing one."""
    key = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(~key.isin(*blanks), key)


def format_mask(c: Column) -> Column:
    """Every digit to 9, so that texts of one format fall together."""
    return F.regexp_replace(c, "[0-9]", "9")
