"""Numbers as report texts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(x: Column, places: int, grouped: bool = False) -> Column:
    text = F.format_number(x, places)
    return text if grouped else F.regexp_replace(text, ",", "")


def money_short(x: Column, places: int = 1, grouped: bool = False) -> Column:
    """``$1.3B``, ``$2.6M``, ``$339K``, ``$12``.

    ``places`` holds for billions and millions; thousands and less are whole.
    Charts use one place, report tables two with grouped digits.
    """
    size, out = F.abs(x), None
    for unit, letter, digits in ((1e9, "B", places), (1e6, "M", places), (1e3, "K", 0)):
        text = F.concat(F.lit("$"), _fixed(x / unit, digits, grouped), F.lit(letter))
        out = F.when(size >= unit, text) if out is None else out.when(size >= unit, text)
    return out.otherwise(F.concat(F.lit("$"), _fixed(x, 0, grouped)))


def percent_text(x: Column, places: int = 1) -> Column:
    return F.concat(_fixed(x * 100, places), F.lit("%"))


def thousands_text(x: Column, places: int = 0) -> Column:
    return F.format_number(x, places)


def times_text(x: Column, places: int = 2) -> Column:
    return F.concat(_fixed(x, places), F.lit("x"))
