"""Case numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.numbers import big, big_text
from caseloom.functions.text import all_digits
from caseloom.plans.lineage import cut_lineage
from caseloom.plans.max_plus import max_plus_scan

DECIMAL_DIGITS = 38  # longest number a DECIMAL(38,0) holds exactly


def max_case_no(df: DataFrame, group_by: Sequence[str] = ("location",)) -> DataFrame:
    """The largest all-digit case_no as a number (0 when none).

    One hash aggregate reads the longest digit count and the DECIMAL(38,0)
    maximum per group; that is exact whenever the longest number has at
    most 38 digits.  The per-group result (one row per site) is
    materialized; only groups holding longer numbers are recomputed from
    their long rows, comparing (digit count, text) -- numeric order for any
    length.  The result is a BIGINT (NULL past its range) and the exact text.
    """
    digits = F.regexp_replace(F.col("case_no"), "^0+", "")
    numeric = df.filter(all_digits("case_no"))
    # a group without any all-digit case_no is 0
    agg = cut_lineage(df.groupBy(*group_by).agg(
        F.max(F.when(all_digits("case_no"), F.length(digits))).alias("_len"),
        F.max(F.when(all_digits("case_no"), F.expr("try_cast(case_no AS DECIMAL(38,0))"))).alias("_dec")))
    fits = agg.filter((F.col("_len") <= DECIMAL_DIGITS) | F.col("_len").isNull()).select(
        *group_by,
        F.when(F.col("_dec").isNull(), F.lit(0).cast("long"))
         .otherwise(F.expr("try_cast(_dec AS BIGINT)")).alias("max_no"),
        F.coalesce(F.col("_dec").cast("string"), F.lit("0")).alias("max_no_text"))
    if agg.filter(F.col("_len") > DECIMAL_DIGITS).limit(1).count() == 0:
        return fits
    long_rows = numeric.filter(F.length(digits) > DECIMAL_DIGITS)
    best = long_rows.groupBy(*group_by).agg(
        F.max(F.struct(F.length(digits).alias("n"), digits.alias("t"))).alias("_m"))
    longer = best.select(*group_by, F.expr("try_cast(_m.t AS BIGINT)").alias("max_no"),
                         F.col("_m.t").alias("max_no_text"))
    return fits.unionByName(longer)


def site_maxima(df: DataFrame, group_by: Sequence[str] = ("location",)) -> DataFrame:
    """A9 for numbering: group_by and ``_start``, the largest all-digit
    case_no (NULL when none).  One hash aggregate, no driver job."""
    return df.groupBy(*group_by).agg(F.max(case_number("case_no")).alias("_start"))


def case_number(col: str) -> Column:
    """The number that a case_no of digits alone stands for, else NULL."""
    return big(F.when(all_digits(col), F.regexp_replace(F.col(col), "^0+(?=.)", "")))


def missing(col: str) -> Column:
    return F.coalesce(F.col(col) == "", F.lit(True))


def number_requests(requests: DataFrame, maxima: DataFrame, group_by: Sequence[str] = ("location",),
                    order_by: Sequence[str] = ("seq", "id"), num_partitions: int | None = None) -> DataFrame:
    """A10: ``requests`` as if made one after another in ``order_by``: a row
    without a case_no gets the site's highest number so far + 1, where given
    numbers of digits alone count from their request on.  ``maxima`` holds the
    highest numbers before the first request (``site_maxima``).  A number that
    was taken in the batch is not handed out again in it."""
    need = missing("case_no")
    out = max_plus_scan(requests, group_by, [*order_by, "case_no"], F.when(need, 1).otherwise(0), case_number("case_no"),
                        maxima.select(*group_by, "_start"), "_number", num_partitions)
    return out.withColumn("case_no", F.when(need, big_text(F.col("_number"))).otherwise(F.col("case_no"))).drop("_number")


def number_batch(batch: DataFrame, existing: DataFrame, group_by: Sequence[str] = ("location",),
                 order_by: Sequence[str] | None = None) -> DataFrame:
    """A10 on a batch of new cases: ``number_requests`` after the numbers of
    ``existing``, in the order of ``seq`` (where the batch has it) and id.
    Only sites that receive numbers are looked up: a semi join whose keys
    prune the other sites' partitions of a stored table."""
    order = list(order_by) if order_by else [c for c in ("seq", "id") if c in batch.columns]
    keys = batch.filter(missing("case_no")).select(*group_by).distinct()
    same = reduce(and_, [existing[c].eqNullSafe(keys[c]) for c in group_by])
    return number_requests(batch, site_maxima(existing.join(keys, same, "left_semi"), group_by), group_by, order)
