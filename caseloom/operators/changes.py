"""Batch table changes on immutable files.

Changes are rows (location, id, op I/U/D, seq, the 10 case fields), folded
per case in the order of seq; the new table is computed and written to a fresh path
(``sources.sinks.publish``), never over the path being read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.dates import ntz
from caseloom.operators.numbering import case_number, missing, number_requests
from caseloom.plans.lineage import cut_lineage
from caseloom.schema import CASE_FIELDS, DEFAULT_STATUS

TEXT_FIELDS = [c for c in CASE_FIELDS if c not in ("case_date", "status")]
#: Ids are unique within a site only, so a case is known by both.
KEY = ("location", "id")


def fold_changes(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per case (location, id) from its ops in the order of ``seq``
    (at one seq: D, I, U, then by the fields):

    * ``deleted``: a D is among them;
    * ``ins``: the first I after the last D (or of all), which takes effect
      if the case was deleted or did not exist;
    * ``upd``: the last U after the last D, which takes effect if the case
      exists or was inserted no later.

    Changes without a site or id name no case and are left out.  All parts
    are partial aggregates, so a case with very many changes is not gathered.
    """
    ch = changes.filter(F.col("location").isNotNull() & F.col("id").isNotNull())
    dels = ch.filter(F.col("op") == "D").groupBy(*KEY).agg(F.max(seq).alias("_del"))
    ch = ch.join(dels, list(KEY), "left")
    fields = F.struct(F.col(seq).alias("seq"), *[F.col(c) for c in CASE_FIELDS])
    after = F.col("_del").isNull() | (F.col(seq) >= F.col("_del"))
    return ch.groupBy(*KEY).agg(
        F.max(F.col("_del").isNotNull()).alias("deleted"),
        F.min(F.when((F.col("op") == "I") & after, fields)).alias("ins"),
        F.max(F.when((F.col("op") == "U") & after, fields)).alias("upd"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """D1/D2 field defaults: text -> '', status -> 'In progress', date as given."""
    out = rows
    for c in TEXT_FIELDS:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    return out.withColumn("status", F.coalesce(F.col("status"), F.lit(DEFAULT_STATUS)))


def apply_changes(base: DataFrame, changes: DataFrame, as_of: dt.datetime, seq: str = "seq") -> DataFrame:
    """D1 + D2 + D3: the case table after the change batch, as if its ops
    were requested one after another.

    * U overwrites all 10 fields of an existing case (missing -> default),
      keeps created_at, sets updated_at; unknown cases: no effect.
    * D removes an existing case; unknown cases: no effect.
    * I adds a new case (an existing one: no effect), numbered by A10 when it
      has no case_no; a U after it overwrites its fields.  Numbers given by
      inserts and updates count from their seq on.
    """
    return _apply(base, cut_lineage(fold_changes(changes, seq)), as_of)


def look_up(base: DataFrame, folded: DataFrame) -> DataFrame:
    """One pass over the base: a row for each changed case that exists
    (location, id, _created), and one a site without id; ``_start`` is the
    highest case number below each.  Aggregated before the shuffle, so what
    moves has the size of the batch.  A base with ``_file`` adds ``_files``,
    where each case is stored."""
    named = folded.select(*KEY, F.lit(True).alias("_named"))
    stored = ["_file"] if "_file" in base.columns else []
    hit = base.select(*KEY, "created_at", "case_no", *stored).join(named, list(KEY), "left")
    files = [F.collect_set(F.when(F.col("_named"), F.col(c))).alias("_files") for c in stored]
    return hit.groupBy("location", F.when(F.col("_named"), F.col("id")).alias("id")).agg(
        F.max("created_at").alias("_created"), F.max(case_number("case_no")).alias("_start"), *files)


def _apply(base: DataFrame, folded: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The table after the folded changes; ``base`` is read twice, for the
    look-up and for the rows that stay."""
    kept = base.join(folded.filter(F.col("deleted") | F.col("upd").isNotNull()).select(*KEY), list(KEY), "left_anti")
    return kept.select(*base.columns).unionByName(changed_rows(base.columns, cut_lineage(look_up(base, folded)), folded, as_of))


def changed_rows(cols: list[str], seen: DataFrame, folded: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Updated and inserted cases, numbered; ``seen`` is ``look_up``'s result."""
    ts = ntz(as_of)
    key = list(KEY)
    maxima = seen.groupBy("location").agg(F.max("_start").alias("_start"))
    found = seen.filter(F.col("id").isNotNull()).select(*key, "_created", F.lit(True).alias("_exists"))
    resolved = folded.join(found, key, "left")
    exists = F.col("_exists").isNotNull()

    def rows(cond, source: str, created) -> DataFrame:
        out = resolved.filter(cond).select(*key, *[F.col(source)[c].alias(c) for c in CASE_FIELDS], created.alias("created_at"))
        return with_defaults(out).withColumn("updated_at", ts).select(*cols)

    changed = exists & ~F.col("deleted") & F.col("upd").isNotNull()
    new = (F.col("deleted") | ~exists) & F.col("ins").isNotNull()
    over = F.coalesce(F.col("upd.seq") >= F.col("ins.seq"), F.lit(False))
    # the requests that take or give numbers, in the order of seq
    asked = lambda cond, source: resolved.filter(cond).select(
        *key, F.col(source)["seq"].alias("seq"), F.lit(source).alias("_kind"), F.col(source)["case_no"].alias("case_no"))
    # an update without a number leaves the site's highest number alone
    updates = asked(changed | new & over, "upd").filter(~missing("case_no"))
    numbered = number_requests(asked(new, "ins").unionByName(updates), maxima).filter(F.col("_kind") == "ins")
    ins = rows(new & ~over, "ins", ts).drop("case_no").join(numbered.select(*key, "case_no"), key)
    return (rows(changed, "upd", F.col("_created")).unionByName(rows(new & over, "upd", ts)).unionByName(ins.select(*cols)))


def purge_site(cases: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """D4 + A17: (table without the site, one-row count of removed rows).
    On partitioned storage the write is a dynamic overwrite of that one
    partition with no rows (see ``sources.sinks``)."""
    gone = cases.filter(F.col("location") == F.lit(site))
    return (cases.filter(F.col("location") != F.lit(site)),
            gone.agg(F.count(F.lit(1)).alias("purged")))
