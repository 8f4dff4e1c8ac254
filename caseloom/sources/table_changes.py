"""Table changes on the stored case table (D1-D4 at rest).

Plain Parquet has no row update, so a change batch replaces files: those that
hold a changed or deleted case are read again, their other rows are written to
new files together with the changed and the new cases, and the next version of
the table names the new files instead of the old ones.  All other files stay
as they are.  Nothing is overwritten, so no copy of the table is needed in
between, and readers see the old version until the new one is complete.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.operators.changes import KEY, changed_rows, fold_changes, look_up
from caseloom.plans.lineage import cut_lineage
from caseloom.schema import CASES
from caseloom.sources import versions
from caseloom.sources.sinks import write_case_files

_FILE = "_metadata.file_path"


def _with_file(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    base = f"{path.rstrip('/')}/data"
    df = spark.read.schema(CASES).option("basePath", base).parquet(*[f"{base}/{f}" for f in files])
    return df.select(*[f.name for f in CASES.fields], F.col(_FILE).alias("_file"))


def apply_changes_to_table(spark: SparkSession, path: str, changes: DataFrame, as_of: dt.datetime,
                           seq: str = "seq") -> dict[str, int]:
    """D1-D3 on the stored table; returns the rows written for each site of a
    changed, deleted or new case (0: none is left in the replaced files).  One
    pass over the keys of the named sites finds the cases, their files and the
    highest numbers; then only the touched files are read."""
    seen_version, files = versions.current(spark, path)
    folded = cut_lineage(fold_changes(changes, seq))
    named = folded.select("location").distinct()
    if files:
        table = _with_file(spark, path, files)
        # the sites are the partitions: the semi join prunes those that no change names
        seen = cut_lineage(look_up(table.join(named, "location", "left_semi"), folded))
    else:
        table, seen = None, look_up(versions.read_files(spark, path, CASES, []).withColumn("_file", F.lit(None).cast("string")), folded)
    gone = folded.filter(F.col("deleted") | F.col("upd").isNotNull()).select(*KEY)
    # at most one row a file
    hit = seen.filter(F.col("id").isNotNull()).join(gone, list(KEY), "left_semi").select("location", F.explode("_files").alias("_file")).distinct().collect()
    touched = sorted({versions.relative(r["_file"]) for r in hit})
    cols = [f.name for f in CASES.fields]
    new = changed_rows(cols, seen, folded, as_of)
    if touched:
        new = versions.read_files(spark, path, CASES, touched).join(gone, list(KEY), "left_anti").select(*cols).unionByName(new)
    data = versions.new_data_path(path)
    write_case_files(new, data)
    written = spark.read.schema(CASES).parquet(data).groupBy("location").count().collect()  # one row a site
    counts = dict.fromkeys(sorted({r["location"] for r in hit}), 0) | {r["location"]: r["count"] for r in written}
    if counts:
        versions.commit(spark, path, data, touched, CASES, seen_version)
    return counts


def purge_site_table(spark: SparkSession, path: str, site: str) -> int:
    """D4 + A17 on the stored table: count the site's rows (file footers
    only), then publish a version without its files.  The files themselves
    stay for readers of older versions."""
    seen_version, files = versions.current(spark, path)
    if not files:
        return 0
    rows = (_with_file(spark, path, files).filter(F.col("location") == F.lit(site))
            .groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a file
    if rows:
        versions.commit(spark, path, None, [versions.relative(r["_file"]) for r in rows], seen=seen_version)
    return sum(r["n"] for r in rows)
