"""Dates to YYYY-MM as Column expressions.

Free text falls back to a month name and a year, or a full numeric date; a
year without a month gives January, text without a year gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.constants import MONTH_YEAR, ONGOING, YEAR_MONTH, YEAR_ONLY

from .text import once, strip

_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAMED = r"(?i)(?<![a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\.?(?![a-z])"


def is_ongoing(c: Column) -> Column:
    return F.lower(strip(c)).isin(*ONGOING)


def _year_month(year: Column, month: Column) -> Column:
    y, m = year.try_cast("int"), month.try_cast("int")
    return F.when(y.between(1900, 2100) & m.between(1, 12), F.format_string("%04d-%02d", y, m))


def normalize_date(c: Column) -> Column:
    return once(strip(c), _date)


def _date(d: Column) -> Column:
    """The month of a stripped text."""
    part = lambda pattern, i: F.regexp_extract(d, pattern, i)
    mm_first, yy_first = MONTH_YEAR, YEAR_MONTH
    full_iso, full_us = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})(?:[T ].*)?$", r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
    month = F.array_position(F.array(*map(F.lit, _NAMES)), F.lower(part(_NAMED, 1))).cast("string")
    year = part(r"(?<!\d)(\d{4})(?!\d)", 1)
    us_month = F.when(part(full_us, 1).try_cast("int") > 12, part(full_us, 2)).otherwise(part(full_us, 1))
    return (
        F.when(F.coalesce(d, F.lit("")) == "", None)
        .when(F.lower(d).isin(*ONGOING), None)
        .when(d.rlike(YEAR_ONLY), F.concat(d, F.lit("-01")))
        .when(d.rlike(mm_first), _year_month(part(mm_first, 2), part(mm_first, 1)))
        .when(d.rlike(yy_first), _year_month(part(yy_first, 1), part(yy_first, 2)))
        .when(d.rlike(full_iso), _year_month(part(full_iso, 1), part(full_iso, 2)))
        .when(d.rlike(full_us), _year_month(part(full_us, 3), us_month))
        .when(d.rlike(_NAMED) & (year != ""), _year_month(year, month))
    )


def experience_dates(entries: Column) -> Column:
    """Starts and ends normalised, or kept as they are; ongoing ends are null."""
    return F.transform(
        entries,
        lambda e: e.withField("start", F.coalesce(normalize_date(e["start"]), e["start"])).withField(
            "end", F.when(~F.coalesce(is_ongoing(e["end"]), F.lit(False)), F.coalesce(normalize_date(e["end"]), e["end"]))
        ),
    )
