"""Exact half-up rounding in integer arithmetic (rates and shares)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up_percent(part: str | Column, total: str | Column) -> Column:
    """``round(part / total * 100)`` half-up, as an integer; 0 when total is 0."""
    p, t = _c(part).cast("long"), _c(total).cast("long")
    return F.when(t > 0, F.floor((p * 200 + t) / (t * 2)).cast("long")).otherwise(F.lit(0).cast("long"))


def half_up_share(part: str | Column, total: str | Column) -> Column:
    """``part / total * 100`` rounded half-up to one decimal; 0.0 when total is 0."""
    p, t = _c(part).cast("long"), _c(total).cast("long")
    tenths = F.floor((p * 2000 + t) / (t * 2)).cast("long")
    return F.when(t > 0, tenths.cast("double") / F.lit(10.0)).otherwise(F.lit(0.0))


#: Whole numbers of up to 56 digits are (high, low) with low below this limb.
LIMB = 10**18


def big(text: Column) -> Column:
    """A text of digits as a struct (high, low) that compares as a number;
    NULL for NULL and beyond 56 digits."""
    high = F.when(F.length(text) > 18, F.left(text, F.length(text) - 18)).otherwise(F.lit("0")).try_cast("decimal(38,0)")
    return F.when(high.isNotNull() & text.isNotNull(), F.struct(high.alias("high"), F.right(text, F.lit(18)).try_cast("long").alias("low")))


def big_plus(number: Column, n: Column) -> Column:
    """number + n, for \\|n\\| below 10^18; may be below 0 in high."""
    low = number["low"] + n
    carry = F.when(low >= LIMB, 1).when(low < 0, -1).otherwise(0)
    return F.when(number.isNotNull(), F.struct((number["high"] + carry).cast("decimal(38,0)").alias("high"), (low - carry * F.lit(LIMB)).cast("long").alias("low")))


def big_text(number: Column) -> Column:
    return F.when(number["high"] > 0, F.concat(number["high"].cast("string"), F.lpad(number["low"].cast("string"), 18, "0"))).otherwise(number["low"].cast("string"))
