"""String predicates and projections (F4, F5, F11, P4, P5, strip)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.schema import DISPLAY_TRUNCATE, PLACEHOLDERS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Remove leading and trailing whitespace like Python's ``str.strip``
    (Unicode whitespace, tabs, newlines and the separators U+001C to U+001F
    and U+0085 included; ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(c), r"^[\x09-\x0D\x1C-\x20\x85\p{Z}]+|[\x09-\x0D\x1C-\x20\x85\p{Z}]+$", "")


def present(c: str | Column) -> Column:
    """not NULL and not the empty string (``c IS NOT NULL AND c != ''``)."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


#: Collations by option: letter case, accents and trailing spaces don't count; in substrings spaces do.
EQUAL_AI, SUBSTRING_AI = "UNICODE_CI_AI_RTRIM", "UNICODE_CI_AI"


def collation_key(c: str | Column, collation: str | None) -> Column:
    """Grouping key under a collation.  ``None`` is binary; ``"ci"`` merges
    values that differ only in letter case or trailing spaces, by a plain
    derived string, so grouping stays a hash aggregate; ``"ai"`` also merges
    letters that differ only in accents (the default of a case- and
    accent-insensitive, PAD SPACE database), as a collated string, whose
    grouping is a sort aggregate and whose joins are on its sort key."""
    c = F.col(c) if isinstance(c, str) else c
    if collation is None:
        return c
    if collation == "ci":
        return F.lower(F.rtrim(c))
    if collation == "ai":
        return F.collate(c, EQUAL_AI)
    raise ValueError(f"unknown collation {collation!r}")


def all_digits(c: str | Column) -> Column:
    """text made only of ASCII digits (``REGEXP '^[0-9]+$'``)."""
    return _c(c).rlike("^[0-9]+$")


def not_placeholder(token: str | Column) -> Column:
    """a resolver token that is a real name, not a form placeholder."""
    return ~_c(token).isin(*PLACEHOLDERS)


def truncate_text(c: str | Column, n: int = DISPLAY_TRUNCATE) -> Column:
    """P4 cut: first ``n`` characters + ``...`` when longer; NULL/'' -> ''."""
    c = _c(c)
    return (F.when(c.isNull(), F.lit(""))
             .when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("...")))
             .otherwise(c))


def or_dash(c: str | Column) -> Column:
    """NULL or '' shown as '-'."""
    c = _c(c)
    return F.when(c.isNull() | (c == ""), F.lit("-")).otherwise(c)


def status_class(c: str | Column) -> Column:
    """CSS class of a status: progress / completed / pending."""
    s = F.lower(_c(c))
    return (F.when(s == "in progress", F.lit("progress"))
             .when(s == "completed", F.lit("completed"))
             .otherwise(F.lit("pending")))


def display_label(full_name: str | Column, eid: str | Column) -> tuple[Column, Column]:
    """P5: (``full_name or eid``, ``"<name> (<eid>)"``)."""
    name = F.coalesce(F.nullif(_c(full_name), F.lit("")), _c(eid))
    return name, F.concat(name, F.lit(" ("), _c(eid), F.lit(")"))
