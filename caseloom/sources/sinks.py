"""Sinks (S4, S5, S6) and the publish step of batch changes.

Case rows are written below a fresh folder and published as the table's next
version (``sources.versions``); nothing that may be read is overwritten.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.schema import CASES, STORED_USERS
from caseloom.sources import versions


#: Rows of one export file, which one task writes and one task reads again.
EXPORT_FILE_ROWS = 500_000


def write_case_files(df: DataFrame, data_path: str) -> None:
    """Case rows as Parquet files partitioned by site, clustered by case_date
    inside each site so that min/max statistics prune date ranges; bloom
    filters on id and case_no prune point lookups, which dates do not.
    ``rebalance`` lets AQE split a hot (site, month) over several writer tasks
    and merge small ones, instead of one task per hash bucket."""
    cols = [f.name for f in CASES.fields]
    writer = (df.select(*cols)
              .withColumn("_month", F.trunc("case_date", "month"))
              .hint("rebalance", "location", "_month")
              .sortWithinPartitions("location", "case_date", "id")
              .drop("_month").write)
    for c in ("id", "case_no"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy("location").parquet(data_path)


def append_cases(clean: DataFrame, path: str) -> int:
    """Add imported/created rows to the case table; its new version."""
    data = versions.new_data_path(path)
    write_case_files(clean, data)
    return versions.commit(clean.sparkSession, path, data, schema=CASES)


def publish(df: DataFrame, path: str) -> int:
    """Replace the whole case table by a recomputed one, at once."""
    spark = df.sparkSession
    seen, old = versions.current(spark, path)
    data = versions.new_data_path(path)
    write_case_files(df, data)
    return versions.commit(spark, path, data, old, CASES, seen)


def append_users(users: DataFrame, path: str) -> None:
    """Add user rows to the user table; columns that the rows lack are
    NULL, columns the table lacks (a request's extras) are left out."""
    cols = [(F.col(f.name) if f.name in users.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STORED_USERS.fields]
    users.select(*cols).write.mode("append").parquet(path)


def export_cases(sheet: DataFrame, path: str, fmt: str = "csv", file_rows: int = EXPORT_FILE_ROWS) -> None:
    """Write the export sheet with its display headers, one folder per
    site for a per-site sheet.  A numbered sheet is cut into files of at most
    ``file_rows`` rows, ``file=<ordinal>`` folders whose names sort as their
    rows do: a site of any size is written, and imported again, by many tasks.
    One shuffle deals the rows to their files."""
    site = ["location"] if "location" in sheet.columns else []
    number = F.col("`No.`").try_cast("long")
    if dict(sheet.dtypes).get("No.") in ("bigint", "int"):
        sheet = sheet.withColumn("file", F.lpad(F.floor((number - 1) / file_rows).cast("string"), 8, "0"))
        sheet = sheet.repartition(*site, "file").sortWithinPartitions(*site, "file", "`No.`")
        w = sheet.write.mode("overwrite").partitionBy(*site, "file")
    else:
        w = sheet.write.mode("overwrite")
        w = w.partitionBy(*site) if site else w
    if fmt == "csv":
        # lossless: line breaks, quotes and padding come back through read_import
        w.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    else:
        w.format(fmt).save(path)


def snapshot(tables: dict[str, DataFrame], snapshot_dir: str) -> dict[str, str]:
    """Full copy of every table in a new folder under ``snapshot_dir``;
    earlier snapshots stay.  Its entry in ``snapshot_dir/complete`` (table,
    path, rows) is written last, so only complete ones have one.  Returns the
    written paths."""
    base = snapshot_dir.rstrip("/")
    at = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}"
    paths = {name: f"{base}/{at}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(paths[name])
    spark = next(iter(tables.values())).sparkSession
    place = spark.createDataFrame([(n, f"{at}/{n}") for n in sorted(paths)], "table string, path string")
    entry = place.join(snapshot_counts(spark, paths), "table").select("table", "path", "rows")
    entry.coalesce(1).write.mode("errorifexists").parquet(f"{base}/complete/at={at}")
    return paths


def newest_snapshot(spark: SparkSession, snapshot_dir: str) -> dict[str, str]:
    """The paths of the newest complete snapshot by table ({} without one)."""
    base = snapshot_dir.rstrip("/")
    found = versions.read_or_none(spark, f"{base}/complete", "table string, path string, rows long, at string")
    if found is None:
        return {}
    newest = found.groupBy("table").agg(F.max_by(F.struct("at", "path"), "at").alias("x")).select("table", "x.*").collect()
    last = max(r["at"] for r in newest)
    return {r["table"]: f"{base}/{r['path']}" for r in newest if r["at"] == last}


def snapshot_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """S6 report: rows per table, read back from the snapshot."""
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
             for n, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
