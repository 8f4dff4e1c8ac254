"""Date expressions: import parse (X1), export format (P3), month range."""

from __future__ import annotations

import re

import datetime as dt

from pyspark.sql import Column, functions as F

from caseloom.schema import EXPORT_DATE_FORMAT, IMPORT_DATE_FORMATS, TWO_DIGIT_YEAR_PIVOT


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _shape(fmt: str) -> str:
    """A regex that every text matches which the format accepts."""
    runs = {"yyyy": r"[+-]?\d{4,}", "yy": r"\d{2}", "MMM": r"[^\d\s/-]+", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "^" + re.sub("y+|M+|d+", lambda m: runs[m[0]], fmt) + "$"


def parse_case_date(c: str | Column) -> Column:
    """Parse a text cell with the import formats, first hit wins, else NULL.

    Spark reads a two-digit year into 2000..2099; the application's parser
    maps 69..99 to the 1900s, so those dates move back 100 years.
    """
    text = _c(c)
    tries = []
    for fmt in IMPORT_DATE_FORMATS:
        # a cell of another shape cannot match: parsing it would raise inside
        d = F.when(text.rlike(_shape(fmt)), F.try_to_date(text, fmt))
        if fmt.endswith("yy") and not fmt.endswith("yyyy"):
            d = F.when(F.year(d) >= TWO_DIGIT_YEAR_PIVOT, F.add_months(d, -1200)).otherwise(d)
        tries.append(d)
    return F.coalesce(*tries)


def export_date(c: str | Column) -> Column:
    """``D-MMM-YY`` text (``1-Dec-25``); NULL -> ''."""
    return F.coalesce(F.date_format(_c(c), EXPORT_DATE_FORMAT), F.lit(""))


def month_start(as_of: dt.date) -> dt.date:
    return as_of.replace(day=1)


def next_month_start(as_of: dt.date) -> dt.date:
    first = as_of.replace(day=1)
    return (first + dt.timedelta(days=32)).replace(day=1)


def in_month(c: str | Column, as_of: dt.date) -> Column:
    """``c`` falls in the calendar month of ``as_of``.

    Written as a half-open range on the raw column so that it reaches the
    Parquet scan as pushed filters (``month(c) = m`` would not).
    """
    c = _c(c)
    return (c >= F.lit(month_start(as_of))) & (c < F.lit(next_month_start(as_of)))


def ntz(value: dt.datetime | dt.date) -> Column:
    """A TIMESTAMP_NTZ literal that does not depend on any time zone (the
    value is cast from its text form, not converted through local time)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def to_date_bound(value: str | dt.date | None) -> dt.date | None:
    """Parse a date bound on the driver: malformed input is a clear error."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value).strip())
