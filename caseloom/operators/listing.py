"""Case list: ordering, paging, text projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

DATE_COLUMNS = ("case_date", "created_at", "updated_at")


def with_text_dates(df: DataFrame) -> DataFrame:
    """All columns, dates and timestamps rendered as text."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in DATE_COLUMNS else F.col(c) for c in df.columns])


def newest(df: DataFrame, limit: int | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """O1: newest first (id descending), optionally the first ``limit`` rows.

    Without ``group_by`` a limit plans as TakeOrderedAndProject (a per-
    partition top-k, then a merge of k rows per partition).  With
    ``group_by`` (one page per site) ``row_number() <= limit`` plans as a
    per-partition group limit before the shuffle.
    """
    if limit is None:
        return df.orderBy(F.desc("id"))
    if not group_by:
        return df.orderBy(F.desc("id")).limit(limit)
    w = Window.partitionBy(*group_by).orderBy(F.desc("id"))
    return (df.withColumn("_page_rn", F.row_number().over(w)).filter(F.col("_page_rn") <= limit)
              .drop("_page_rn"))


def oldest_first(df: DataFrame) -> DataFrame:
    """O2: id ascending (export order)."""
    return df.orderBy("id")


def page_limit(limit: str | int | None) -> int | None:
    """The list applies a limit only when it is all digits."""
    if limit is None:
        return None
    s = str(limit)
    return int(s) if s.isdigit() else None
