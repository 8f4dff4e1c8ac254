"""Optional case filters folded into one predicate.

An empty argument means "no predicate".  Date bounds are parsed on the
driver, so the comparison is against a typed literal and reaches the Parquet
scan as a pushed filter.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.dates import to_date_bound
from caseloom.functions.text import SUBSTRING_AI, collation_key

LIST_SEARCH_COLUMNS = ("case_no", "description", "opened_by", "step_to_resolve")
STATS_SEARCH_COLUMNS = ("case_no", "description", "opened_by")


def like_pattern(term: str) -> str:
    """``%term%`` as a Spark LIKE pattern with the database's backslash rules:
    ``\\%``, ``\\_`` and ``\\\\`` stay escapes, a backslash before any other
    character stands for that character, and a trailing backslash is a
    literal backslash (Spark would reject the last two)."""
    out, i = [], 0
    while i < len(term):
        ch = term[i]
        if ch == "\\":
            nxt = term[i + 1] if i + 1 < len(term) else None
            if nxt is None:
                out.append("\\\\")
            elif nxt in "%_\\":
                out.append("\\" + nxt)
            else:
                out.append(nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def plain_parts(term: str) -> list[str]:
    """The texts between the wildcards of ``like_pattern(term)``."""
    parts, escaped = [""], False
    for ch in like_pattern(term):
        if escaped:
            parts[-1], escaped = parts[-1] + ch, False
        elif ch == "\\":
            escaped = True
        elif ch in "%_":
            parts.append("")
        else:
            parts[-1] += ch
    return [p for p in parts if p]


def search(term: str, columns=LIST_SEARCH_COLUMNS, pattern: bool = False, collation: str | None = None) -> Column:
    """OR over ``columns`` of a substring match, in either letter case
    under ``collation="ci"``, with or without accents too under ``"ai"``
    (spaces always count in a substring).

    ``pattern=False`` matches the term literally (``%`` and ``_`` are plain
    characters); ``pattern=True`` keeps them as LIKE wildcards.
    """
    cols = [F.col(c) for c in columns]
    if collation == "ai":
        if pattern:
            raise ValueError("patterns compare letters with their accents; use collation='ci'")
        return F.coalesce(reduce(lambda a, b: a | b, [F.collate(c, SUBSTRING_AI).contains(F.collate(F.lit(term), SUBSTRING_AI)) for c in cols]), F.lit(False))
    if collation is not None:
        cols, term = [F.lower(c) for c in cols], term.lower()
    if pattern:
        preds = [c.like(like_pattern(term)) for c in cols]
    else:
        preds = [c.contains(F.lit(term)) for c in cols]
    return F.coalesce(reduce(lambda a, b: a | b, preds), F.lit(False))


@dataclass(frozen=True)
class CaseFilter:
    """The filter bar of the case list (F1, F2, F3).  Unset fields add no
    predicate."""

    status: str | None = None
    department: str | None = None
    issues: str | None = None
    from_date: str | dt.date | None = None
    to_date: str | dt.date | None = None
    search: str | None = None
    search_columns: tuple[str, ...] = LIST_SEARCH_COLUMNS
    search_pattern: bool = False
    site: str | None = None
    collation: str | None = None  # None compares bytes; "ci" ignores case and trailing spaces, "ai" accents as well

    def for_stats(self) -> "CaseFilter":
        """The KPI panel ignores the status filter and searches 3 columns."""
        return replace(self, status=None, search_columns=STATS_SEARCH_COLUMNS)

    def for_report(self) -> "CaseFilter":
        """The report takes the date range and department only."""
        return CaseFilter(department=self.department, from_date=self.from_date, to_date=self.to_date,
                          site=self.site, collation=self.collation)

    def predicates(self) -> list[Column]:
        preds: list[Column] = []
        if self.site:
            preds.append(F.col("location") == F.lit(self.site))
        for name in ("status", "department", "issues"):
            value = getattr(self, name)
            if value:
                preds.append(collation_key(name, self.collation) == collation_key(F.lit(value), self.collation))
        lo, hi = to_date_bound(self.from_date), to_date_bound(self.to_date)
        if lo is not None:
            preds.append(F.col("case_date") >= F.lit(lo))
        if hi is not None:
            preds.append(F.col("case_date") <= F.lit(hi))
        if self.search:
            preds.append(search(self.search, self.search_columns, self.search_pattern, self.collation))
        return preds

    def apply(self, df: DataFrame) -> DataFrame:
        preds = self.predicates()
        return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def by_key(df: DataFrame, col: str, value) -> DataFrame:
    """point lookup (reaches Parquet row-group statistics)."""
    return df.filter(F.col(col) == F.lit(value))
