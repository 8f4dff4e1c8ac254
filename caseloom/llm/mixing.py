"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight; a target above ``cap`` times its
source's size stops there, and the excess goes to the others by weight
(water filling in closed form over the sorted caps).  A document's wanted
copies are its source's target over its size, times an optional weight of its
own.  The whole part is allocated with certainty; the fraction is its
inclusion probability p.  Documents are ranked by (u/(1-u)) / (p/(1-p)) with
u a hash of the id, and taken in that order until the source's remaining
words are met; then one further document is added where its size brings the
total nearer to the target.

The order of a source is never sorted as a whole: ranks are mapped into
(0, 1), and two histogram passes of 1024 cells each narrow the cut down to a
millionth of a source, so a hot source costs no more than others.

Defined results: null and empty texts have size 0 and are taken 0 times; a
null source is a source of its own, last in order; rows with equal id, size
and source share one rank and are taken together; a null id counts as an id;
an empty table gives no rows.  Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import WORD, text_or_empty, written

WEIGHTS = (5, 2, 1)
CELLS = 1024
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the seed and the id only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """mix_source, source_size, target and mass (weighted words) of each
    source.  sized: mix_source, mix_size, mix_weight.  One row per source."""
    s = sized.groupBy("mix_source").agg(F.sum("mix_size").cast("long").alias("source_size"), F.sum(F.col("mix_size") * F.col("mix_weight")).alias("mass"))
    place = F.row_number().over(W.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    # sources reach their caps in the order of most / w; place k is capped if the level before it exceeds its ratio
    order = W.orderBy((F.col("most") / F.col("w")).asc(), F.col("mix_source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("budget", F.lit(share) * F.sum("source_size").over(W.partitionBy()))
         .withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_w"))
         .withColumn("full", F.col("level") * F.col("w") >= F.col("most")))
    s = s.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy()))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("w")))
    return s.select("mix_source", "source_size", "mass", target.alias("target"))


def _wanted(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """Rows with their source's plan, certain copies, and rank in (0, 1)."""
    c = F.col
    rows = rows.join(plan, rows["mix_source"].eqNullSafe(plan["of_source"]), "left").drop("of_source")
    copies = F.when(c("mass") > 0, F.least(F.lit(cap), c("target") * c("mix_weight") / c("mass"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("mix_copies", copies).withColumn("mix_sure", F.floor("mix_copies").cast("long"))
    p = c("mix_copies") - c("mix_sure")
    odds = c("mix_u") / (1 - c("mix_u")) * (1 - p) / p
    # a probability of 0 ranks after every positive one, still in the order of u
    rank = F.when(p > 0, odds / (1 + odds) * 0.999).otherwise(0.999 + 0.001 * c("mix_u"))
    rows = rows.withColumn("mix_rank", rank).withColumn("mix_open", (c("mix_sure") + 1 <= F.lit(cap)) & (c("mix_size") > 0))
    at = c("mix_rank") * CELLS
    return rows.withColumn("mix_cell", F.floor(at).cast("int")).withColumn("mix_fine", F.floor((at - F.floor(at)) * CELLS).cast("int"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with mix_size, mix_source_size,
    mix_target, mix_times (copies taken) and mix_taken (words taken)."""
    c = F.col
    own = F.lit(1.0) if weight is None else F.greatest(F.lit(0.0), F.coalesce(weight.cast("double"), F.lit(0.0)))
    rows = docs.select(
        F.struct(*[docs[x] for x in docs.columns]).alias("mix_row"), n_words(text_or_empty()).alias("mix_size"), c("source").cast("string").alias("mix_source"),
        own.alias("mix_weight"), uniform(c("doc_id"), seed).alias("mix_u"), F.coalesce(c("doc_id").cast("string"), F.lit("")).alias("mix_id"))
    slim = written(rows.select("mix_id", "mix_source", "mix_size", "mix_weight", "mix_u"), "mix-sizes")
    plan = written(source_targets(slim, weights, share, cap).withColumnRenamed("mix_source", "of_source"), "mix-targets")
    slim = _wanted(slim, plan, cap)
    open_ = slim.filter("mix_open")
    cells = slim.groupBy("mix_source", "mix_cell").agg(
        F.sum(c("mix_sure") * c("mix_size")).alias("sure"), F.sum(F.when(c("mix_open"), c("mix_size")).otherwise(0)).alias("words"), F.max("target").alias("target"))
    # the first cell at which the words reach what is left after the certain copies
    source = W.partitionBy("mix_source")
    upto = source.orderBy("mix_cell").rowsBetween(W.unboundedPreceding, 0)
    cells = (cells.withColumn("left", F.least(c("target") - F.sum("sure").over(source), F.sum("words").over(source).cast("double"))).withColumn("sum", F.sum("words").over(upto))
             .filter(c("sum") >= c("left")).groupBy("mix_source")
             .agg(F.min(F.struct("mix_cell", (c("left") - c("sum") + c("words")).alias("left"))).alias("x"))
             .select(c("mix_source").alias("of"), c("x.mix_cell").alias("cut_cell"), c("x.left").alias("left_1")))
    fine = (open_.join(cells, open_["mix_source"].eqNullSafe(c("of")) & (c("mix_cell") == c("cut_cell")))
            .groupBy("of", "cut_cell", "left_1", "mix_fine").agg(F.sum("mix_size").alias("words")))
    upto = W.partitionBy("of").orderBy("mix_fine").rowsBetween(W.unboundedPreceding, 0)
    fine = (fine.withColumn("sum", F.sum("words").over(upto)).filter(c("sum") >= c("left_1")).groupBy("of")
            .agg(F.min(F.struct("mix_fine", "cut_cell", (c("left_1") - c("sum") + c("words")).alias("left"))).alias("x"))
            .select("of", c("x.cut_cell").alias("cut_cell"), c("x.mix_fine").alias("cut_fine"), c("x.left").alias("left_2")))
    # rows of the cut cell, equal ranks as one; all that still fit are taken in order
    near = (open_.join(fine, open_["mix_source"].eqNullSafe(c("of")) & (c("mix_cell") == c("cut_cell")) & (c("mix_fine") == c("cut_fine")))
            .groupBy("of", "cut_cell", "cut_fine", "left_2", "mix_rank", "mix_id", "mix_size").agg(F.sum("mix_size").alias("words")))
    upto = W.partitionBy("of").orderBy("mix_rank", "mix_id", "mix_size").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("sum", F.sum("words").over(upto))
    last = F.max(F.when(c("sum") <= c("left_2"), F.struct("sum", "mix_rank", "mix_id", "mix_size")))
    cuts = near.groupBy("of", "cut_cell", "cut_fine", "left_2").agg(last.alias("x")).select(
        "of", "cut_cell", "cut_fine", c("x.mix_rank").alias("cut_rank"), c("x.mix_id").alias("cut_id"), c("x.mix_size").alias("cut_size"),
        (c("left_2") - F.coalesce(c("x.sum"), F.lit(0))).alias("gap"))
    cuts = written(cuts, "mix-cuts")

    def inside() -> Column:
        cell, fine = c("mix_cell"), c("mix_fine")
        same = F.struct("mix_rank", "mix_id", "mix_size") <= F.struct("cut_rank", "cut_id", "cut_size")
        in_cut = (cell == c("cut_cell")) & ((fine < c("cut_fine")) | (fine == c("cut_fine")) & c("cut_rank").isNotNull() & same)
        return F.coalesce(c("mix_open") & ((cell < c("cut_cell")) | in_cut), F.lit(False))

    # the further document: the size nearest to the gap, if that is nearer than taking none
    # sizes repeat, so the ids of one size are ranked only where that size is chosen
    rest = slim.join(cuts, slim["mix_source"].eqNullSafe(c("of"))).filter(c("mix_open") & ~inside() & (F.abs(c("mix_size") - c("gap")) < c("gap")))
    extra = rest.groupBy("of").agg(F.min(F.struct(F.abs(c("mix_size") - c("gap")).alias("off"), "mix_rank", "mix_id", "mix_size")).alias("x"))
    extra = extra.select("of", c("x.mix_rank").alias("more_rank"), c("x.mix_id").alias("more_id"), c("x.mix_size").alias("more_size"))
    cuts = written(cuts.join(extra.withColumnRenamed("of", "of2"), c("of").eqNullSafe(c("of2")), "left").drop("of2", "gap"), "mix-last")

    out = _wanted(rows, plan, cap)
    out = out.join(cuts, out["mix_source"].eqNullSafe(c("of")), "left")
    more = F.coalesce((c("mix_rank") == c("more_rank")) & (c("mix_id") == c("more_id")) & (c("mix_size") == c("more_size")), F.lit(False))
    times = (c("mix_sure") + F.when(inside() | c("mix_open") & more, 1).otherwise(0)).cast("long")
    out = out.withColumn("mix_times", F.when(c("mix_size") > 0, times).otherwise(0)).withColumn("mix_taken", c("mix_times") * c("mix_size"))
    made = {"mix_size": c("mix_size"), "mix_source_size": c("source_size"), "mix_target": c("target"), "mix_times": c("mix_times"), "mix_taken": c("mix_taken")}
    return out.select(*[c("mix_row")[x].alias(x) for x in docs.columns if x not in made], *[v.alias(k) for k, v in made.items()])
