"""Running case numbers as a max-plus prefix scan.

A request changes the highest number n of its site by ``n -> max(n + a, b)``:
a request without a number has a = 1 (it takes n + 1), one with a given number
g has a = 0 and b = g, any other leaves n alone.  Such functions are closed
under composition, so their prefixes are computed in two levels: inside every
range partition of (group, order), and over the partitions, of which there is
one row a group and partition.  With A the running sum of a, the number after
a row is ``A + max(n0, max over the rows so far of (b - A at that row))``.

No task holds more than one range partition, however hot a group is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.numbers import big_plus
from caseloom.plans.lineage import cut_lineage

_POS_BITS = 33  # monotonically_increasing_id: partition id in the upper bits


def max_plus_scan(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], step: Column, floor: Column,
                  start: DataFrame, out_col: str, num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``out_col``, the number (``functions.numbers.big``) after
    each row, in the order of ``order_by`` inside its group.  ``step`` is a as
    a BIGINT, ``floor`` b (NULL: none); ``start`` holds group_by and ``_start``
    (a missing group starts at NULL, which counts as 0)."""
    group = list(group_by)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.withColumn("_step", step.cast("long")).withColumn("_floor", floor)
              .repartitionByRange(n, *[F.col(c) for c in group], *[F.col(c) for c in order_by])
              .sortWithinPartitions(*group, *order_by).withColumn("_at", F.monotonically_increasing_id()))
    rows = cut_lineage(rows).withColumn("_part", F.shiftright("_at", _POS_BITS))
    inside = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_step").over(inside))
    rows = rows.withColumn("_top", F.max(big_plus(F.col("_floor"), -F.col("_sum"))).over(inside))
    # each part's own function, composed with those of the parts before it
    parts = rows.groupBy(*group, "_part").agg(F.sum("_step").alias("_all"), F.max("_top").alias("_high"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    parts = parts.withColumn("_before", F.max(big_plus(F.col("_high"), -F.col("_base"))).over(before))
    parts = parts.join(start, reduce(and_, [parts[c].eqNullSafe(start[c]) for c in group]), "left").select(
        *[parts[c].alias(f"_g{i}") for i, c in enumerate(group)], parts["_part"].alias("_gp"), "_base", "_before", "_start")
    same = reduce(and_, [rows[c].eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
    out = rows.join(parts, same & (rows["_part"] == F.col("_gp")))
    zero = F.struct(F.lit(0).cast("decimal(38,0)").alias("high"), F.lit(0).cast("long").alias("low"))
    highest = F.array_max(F.array(zero, "_start", "_before", big_plus(F.col("_top"), -F.col("_base"))))
    # array_max leaves NULLs out; a zero stands for a site without numbers
    out = out.withColumn(out_col, big_plus(highest, F.col("_base") + F.col("_sum")))
    return out.select(*df.columns, out_col)
