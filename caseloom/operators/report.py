"""Counts, KPI rows, breakdowns, ranks, shares and facets (A1-A8, A12-A14,
W2, W3, O1-O5).

Every operator takes ``group_by`` (default: per site) so that one job serves
all sites; pass ``()`` for the single-site form after a site filter.  All
aggregates are hash aggregates with a partial (map-side) step, so a hot site
or value costs no extra shuffle volume.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.dates import in_month
from caseloom.functions.numbers import half_up_percent, half_up_share
from caseloom.functions.text import collation_key, not_placeholder, present, py_strip
from caseloom.plans.numbering import global_row_number
from caseloom.schema import STATUS_COMPLETED, STATUS_IN_PROGRESS, TOP_N

SITE = ("location",)


def _count_if(pred: Column) -> Column:
    return F.count(F.when(pred, F.lit(1)))


def case_count(df: DataFrame, group_by: Sequence[str] = SITE) -> DataFrame:
    """A1: size of the filtered set, independent of any page limit."""
    return df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("total"))


def stats_kpi(df: DataFrame, as_of: dt.date, group_by: Sequence[str] = SITE) -> DataFrame:
    """A2 + F6: total, in progress, completed, this month -- one scan."""
    return df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(F.col("status") == STATUS_IN_PROGRESS).alias("in_progress"),
        _count_if(F.col("status") == STATUS_COMPLETED).alias("completed"),
        _count_if(in_month("case_date", as_of)).alias("this_month"),
    )


def report_summary(df: DataFrame, group_by: Sequence[str] = SITE) -> DataFrame:
    """A3: total, completed, in progress and the completion rate in whole
    percent (half-up; 0 for an empty set) -- one scan."""
    agg = df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(F.col("status") == STATUS_COMPLETED).alias("completed"),
        _count_if(F.col("status") == STATUS_IN_PROGRESS).alias("in_progress"),
    )
    return agg.withColumn("completion_rate", half_up_percent("completed", "total"))


def present_under(col: str, collation: str | None) -> Column:
    """F4 under a collation: with ``"ci"`` (PAD SPACE) a value of only
    spaces equals '' and is not present."""
    if collation is None:
        return present(col)
    return F.col(col).isNotNull() & (F.rtrim(F.col(col)) != F.lit(""))


def _breakdown(df: DataFrame, col: str, group_by: Sequence[str], collation: str | None = None) -> DataFrame:
    rows = df.filter(present_under(col, collation))
    if collation is None:
        return rows.groupBy(*group_by, F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("count"))
    # one group per collation key; the smallest original spelling is the label
    return (rows.groupBy(*group_by, collation_key(col, collation).alias("_key"))
                .agg(F.min(col).alias("name"), F.count(F.lit(1)).alias("count"))
                .drop("_key"))


def by_issues(df: DataFrame, group_by: Sequence[str] = SITE, collation: str | None = None) -> DataFrame:
    """A4: cases per issue type (present values only)."""
    return _breakdown(df, "issues", group_by, collation)


def by_department(df: DataFrame, group_by: Sequence[str] = SITE, collation: str | None = None) -> DataFrame:
    """A5: cases per department (present values only)."""
    return _breakdown(df, "department", group_by, collation)


def resolver_tokens(resolved_by: str | Column = "resolved_by") -> Column:
    """A6 split: individual resolvers of one row -- split on ',', strip,
    drop blanks and placeholders; a name twice in a row stays twice."""
    c = F.col(resolved_by) if isinstance(resolved_by, str) else resolved_by
    parts = F.transform(F.split(c, ","), lambda t: py_strip(t))
    return F.filter(parts, lambda t: (t != F.lit("")) & not_placeholder(t))


def by_resolver(df: DataFrame, group_by: Sequence[str] = SITE) -> DataFrame:
    """Cases per individual resolver (every occurrence counts).
    The explode runs on the one projected column, on the executors."""
    return (df.filter(present("resolved_by"))
              .select(*group_by, F.explode(resolver_tokens("resolved_by")).alias("name"))
              .groupBy(*group_by, "name").agg(F.count(F.lit(1)).alias("count")))


def by_date(df: DataFrame, group_by: Sequence[str] = SITE) -> DataFrame:
    """A7 + P7: cases per day that occurs (no gap filling)."""
    return (df.filter(F.col("case_date").isNotNull())
              .groupBy(*group_by, F.to_date("case_date").alias("date"))
              .agg(F.count(F.lit(1)).alias("count")))


def by_month(df: DataFrame, group_by: Sequence[str] = SITE) -> DataFrame:
    """Cases per calendar month."""
    return (df.filter(F.col("case_date").isNotNull())
              .groupBy(*group_by, F.trunc("case_date", "month").alias("month"))
              .agg(F.count(F.lit(1)).alias("count")))


DIMENSIONS = ("issues", "department", "resolver", "date")


def report_all(df: DataFrame, group_by: Sequence[str] = SITE) -> DataFrame:
    """Every breakdown of one report as (dimension, name, count) from ONE
    scan and ONE shuffle: each row emits its (dimension, name) pairs, then a
    single hash aggregate counts them."""
    def pair(dim: str, name: Column) -> Column:
        return F.struct(F.lit(dim).alias("dimension"), name.alias("name"))

    singles = F.array(
        F.when(present("issues"), pair("issues", F.col("issues"))),
        F.when(present("department"), pair("department", F.col("department"))),
        F.when(F.col("case_date").isNotNull(), pair("date", F.col("case_date").cast("string"))),
    )
    resolvers = F.transform(
        F.coalesce(F.when(present("resolved_by"), resolver_tokens("resolved_by")),
                   F.array().cast("array<string>")),
        lambda t: pair("resolver", t))
    pairs = F.filter(F.concat(singles, resolvers), lambda p: p.isNotNull())
    return (df.select(*group_by, F.explode(pairs).alias("p"))
              .groupBy(*group_by, F.col("p.dimension").alias("dimension"), F.col("p.name").alias("name"))
              .agg(F.count(F.lit(1)).alias("count")))


def order_by_count(bd: DataFrame) -> DataFrame:
    """O3: count descending, name as the tie-break."""
    return bd.orderBy(F.desc("count"), F.asc("name"))


def display_order(bd: DataFrame) -> list[Column]:
    """Display order of breakdown rows: count descending then name; the
    trend (``dimension = 'date'``) is shown by day ascending instead."""
    if "dimension" not in bd.columns:
        return [F.desc("count"), F.asc("name")]
    trend = F.col("dimension") == F.lit("date")
    return [F.when(trend, F.lit(0)).otherwise(-F.col("count")).asc(), F.asc("name")]


def with_rank(bd: DataFrame, group_by: Sequence[str] = SITE + ("dimension",), out_col: str = "rank") -> DataFrame:
    """1-based position of a breakdown row in display order, no ties.
    Numbered with ``global_row_number``, so a large group is not gathered
    into one task."""
    return global_row_number(bd, display_order(bd), out_col=out_col, partition_by=list(group_by))


def with_share(bd: DataFrame, group_by: Sequence[str] = SITE + ("dimension",)) -> DataFrame:
    """Share of the group's total in % (one decimal, half-up) and the bar
    width (% unrounded) relative to the first displayed row: the largest count, or the
    first day for the trend.  Group totals come from a partial aggregate
    joined back on the group."""
    aggs = [F.sum("count").alias("_total"), F.max("count").alias("_max")]
    if "dimension" in bd.columns:
        aggs.append(F.min_by("count", "name").alias("_first_day"))
    totals = bd.groupBy(*group_by).agg(*aggs)
    if "dimension" in bd.columns:
        first = F.when(F.col("dimension") == "date", F.col("_first_day")).otherwise(F.col("_max"))
    else:
        first = F.col("_max")
    if group_by:
        # null-safe: rows without a site keep their share
        totals = totals.withColumnsRenamed({c: f"_of_{c}" for c in group_by})
        out = bd.join(totals, reduce(and_, [bd[c].eqNullSafe(totals[f"_of_{c}"]) for c in group_by]), "left")
        out = out.drop(*[f"_of_{c}" for c in group_by])
    else:
        # a global aggregate is one row: attach it as scalar subqueries
        out = bd.withColumns({c: totals.select(c).scalar() for c in totals.columns})
    return (out.withColumn("share", half_up_share("count", "_total"))
               .withColumn("bar", F.coalesce(F.lit(100.0) * F.col("count") / F.nullif(first, F.lit(0)), F.lit(0.0)))
               .drop(*[c for c in ("_total", "_max", "_first_day") if c in out.columns]))


def top_n(bd: DataFrame, n: int = TOP_N, group_by: Sequence[str] = SITE + ("dimension",),
          dimensions: Sequence[str] | None = ("issues", "department", "resolver")) -> DataFrame:
    """First ``n`` rows per group in display order (the report's top
    lists cover issues, departments and resolvers).  ``row_number() <= n``
    is planned as a per-partition group limit before the shuffle, so at
    most n rows per group and partition move."""
    if dimensions is not None and "dimension" in bd.columns:
        bd = bd.filter(F.col("dimension").isin(*dimensions))
    w = Window.partitionBy(*group_by).orderBy(*display_order(bd))
    return bd.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def facet(df: DataFrame, col: str, group_by: Sequence[str] = SITE, collation: str | None = None) -> DataFrame:
    """Distinct present values, sorted.  Under ``collation="ci"``
    spellings that compare equal are one value (the smallest spelling)."""
    rows = df.filter(present_under(col, collation))
    if collation is None:
        return rows.select(*group_by, F.col(col).alias("value")).distinct().orderBy(*group_by, "value")
    return (rows.groupBy(*group_by, collation_key(col, collation).alias("_key"))
                .agg(F.min(col).alias("value")).drop("_key").orderBy(*group_by, "value"))


def collect_sorted(col: str | Column) -> Column:
    """The sorted list of a group's non-NULL values (GROUP_CONCAT)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_sort(F.collect_list(c))
