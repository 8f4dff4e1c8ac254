"""Export and display projections (P2, P3, P4, S4 body, A16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.dates import export_date
from caseloom.functions.text import or_dash, status_class, truncate_text
from caseloom.plans.numbering import global_row_number
from caseloom.schema import EXPORT_HEADERS, EXPORT_WIDTH_CAP, EXPORT_WIDTH_PAD

HEADERS = [h for _, h in EXPORT_HEADERS]


def renumber(df: DataFrame, order_col: str = "id", out_col: str = "case_no",
             partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace ``out_col`` by 1..n in ``order_col`` order (per
    ``partition_by`` group), always in the range form: a group of any size
    spreads over the partitions of its order."""
    return global_row_number(df.drop(out_col), [F.col(order_col)], out_col=out_col, partition_by=partition_by,
                             window_group_rows=0)


def export_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P2 + P3: the 10 sheet columns with display headers, date as text."""
    cols = []
    for col, header in EXPORT_HEADERS:
        c = export_date(col) if col == "case_date" else F.col(col)
        cols.append(c.alias(header))
    return df.select(*keep, *cols)


def export_rows(filtered: DataFrame, per_site: bool = True) -> DataFrame:
    """S4 body: filtered rows oldest first, renumbered 1..n (per site when
    ``per_site``), as the export sheet."""
    part = ["location"] if per_site else []
    numbered = renumber(filtered, "id", "case_no", part)
    # The numbered rows are range-partitioned on (site, id) already; sorting
    # inside partitions gives the total order without a second shuffle.
    return export_columns(numbered, keep=part + ["id"]).sortWithinPartitions(*part, "id").drop("id")


def export_widths(sheet: DataFrame, group_by: Sequence[str] = ("location",), cap: int = EXPORT_WIDTH_CAP
                  ) -> DataFrame:
    """Per sheet column ``min(max(longest value, header) + 2, cap)``
    from ONE aggregate over all columns, unpivoted to (column, width).
    NULL cells have length 0."""
    aggs = [F.coalesce(F.max(F.length(F.col(f"`{h}`").cast("string"))), F.lit(0)).alias(f"w{i}")
            for i, h in enumerate(HEADERS)]
    wide = sheet.groupBy(*group_by).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(h).alias("column"),
                               F.least(F.greatest(F.col(f"w{i}"), F.lit(len(h))) + EXPORT_WIDTH_PAD,
                                       F.lit(cap)).cast("int").alias("width"))
                      for i, h in enumerate(HEADERS)])
    return wide.select(*group_by, F.explode(pairs).alias("p")).select(*group_by, "p.column", "p.width")


def sheet_widths(filtered: DataFrame, group_by: Sequence[str] = ("location",), cap: int = EXPORT_WIDTH_CAP
                 ) -> DataFrame:
    """A16 straight from the filtered rows, without numbering them: of the
    numbers 1..n none is longer than n, so the row number's place is taken by
    the count of its group.  One scan, one aggregate."""
    sheet = export_columns(filtered, keep=group_by)
    cells = [F.max(F.length(F.col(f"`{h}`").cast("string"))).alias(h) for h in HEADERS[1:]]
    wide = sheet.groupBy(*group_by).agg(F.length(F.count(F.lit(1)).cast("string")).alias(HEADERS[0]), *cells)
    pairs = F.array(*[F.struct(F.lit(h).alias("column"),
                               F.least(F.greatest(F.coalesce(F.col(f"`{h}`"), F.lit(0)), F.lit(len(h))) + EXPORT_WIDTH_PAD,
                                       F.lit(cap)).cast("int").alias("width")) for h in HEADERS])
    return wide.select(*group_by, F.explode(pairs).alias("p")).select(*group_by, "p.column", "p.width")


def display_rows(df: DataFrame) -> DataFrame:
    """The list as displayed: '-' for missing values, description and
    steps cut to 30 characters + '...', date as D-MMM-YY, status class."""
    return df.select(
        "id", "location",
        or_dash("case_no").alias("case_no"),
        F.coalesce(F.date_format("case_date", "d-MMM-yy"), F.lit("-")).alias("case_date"),
        or_dash("issues").alias("issues"),
        truncate_text("description").alias("description"),
        truncate_text("step_to_resolve").alias("step_to_resolve"),
        or_dash("opened_by").alias("opened_by"),
        or_dash("department").alias("department"),
        or_dash("status").alias("status"),
        status_class("status").alias("status_class"),
        or_dash("resolved_by").alias("resolved_by"),
        or_dash("remark").alias("remark"),
    )
