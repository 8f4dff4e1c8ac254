"""Connected components over an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, component (smallest id reachable) of every id in edges (a, b).

    Alternating large-star and small-star rounds: each round every vertex
    points its neighbours to the smallest one, which halves path lengths, so
    a logarithmic number of rounds suffices.  Minima are partial before their
    shuffle; a hub's edges are joined, not collected.  Every round is written
    to the shared folder."""
    c = F.col
    # b > a always: a is the nearer to the root
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = e.union(e.select(c("b").alias("a"), c("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(c("a").alias("v"), F.least("a", "m").alias("m"))
        large = e.join(least, c("a") == c("v")).select(c("m").alias("a"), c("b").alias("b")).filter("a < b").distinct()
        # small star: smaller neighbours, and the vertex itself, go to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(c("b").alias("v"), "m")
        joined = large.join(least, c("b") == c("v"))
        small = joined.select(c("m").alias("a"), c("a").alias("b")).union(least.select(c("m").alias("a"), c("v").alias("b"))).filter("a < b").distinct()
        new = written(small, name)
        # stars: every vertex has one edge, and no centre is a leaf
        stats = new.agg(F.count(F.lit(1)), F.countDistinct("b")).first()
        leaf_centre = new.select(c("b").alias("x")).distinct().join(new.select(c("a").alias("x")), "x", "left_semi").limit(1).count()
        e = new
        if stats[0] == stats[1] and not leaf_centre:
            break
    return e.select(c("b").alias("id"), c("a").alias("component")).union(e.select("a", "a").distinct().toDF("id", "component"))
