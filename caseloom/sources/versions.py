"""Published versions of a stored table.

A table is a folder with ``data/commit=<id>/...`` (Parquet files, never
changed once written) and ``log/version=<n>/`` (one Parquet file each: the
files that version n adds and removes).  A change writes its data files first
and its log file last.  The log file is a single one, so Spark's commit makes
it visible by one rename: a write that stops halfway leaves data files that no
version names, and readers go on with the version before.  Several readers may
run beside one writer; a second writer of the same version fails, as its
folder exists.

The current files are those whose last entry adds them.  Their list is on the
driver, as the file listing of any Spark table is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "file string, added boolean"


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, None where there is no such path."""
    try:
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        df.schema  # noqa: B018 - resolves the path
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def log(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, added, version) of all versions, None before the first."""
    return read_or_none(spark, f"{path.rstrip('/')}/log", LOG_SCHEMA + ", version long")


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str]]:
    """(version, its files relative to ``data``); (0, []) for a table without
    versions.  An older ``version`` can be read as long as its files stay."""
    entries = log(spark, path)
    if entries is None:
        return 0, []
    if version is not None:
        entries = entries.filter(F.col("version") <= version)
    # the last row, without a file, has the version's number even where no file is left
    rows = entries.groupBy("file").agg(F.max_by("added", "version").alias("added"), F.max("version").alias("version")).collect()
    return max((r.version for r in rows), default=0), sorted(r.file for r in rows if r.added and r.file)


def files_of(df: DataFrame) -> list[str]:
    """The files that ``df`` reads, relative to ``data``."""
    return sorted(relative(f) for f in df.inputFiles())


def relative(uri: str) -> str:
    plain = unquote(uri)
    return plain[plain.rindex("/data/commit=") + len("/data/"):]


def read_files(spark: SparkSession, path: str, schema, files: list[str]) -> DataFrame:
    """Only these files of the table, with its partition columns."""
    names = [f.name for f in schema.fields]
    if not files:
        return spark.createDataFrame([], schema)
    base = f"{path.rstrip('/')}/data"
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in files]).select(*names)


def new_data_path(path: str) -> str:
    """Where a change writes its files."""
    return f"{path.rstrip('/')}/data/commit={uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, data_path: str | None, removed: Iterable[str] = (), schema=None, seen: int | None = None) -> int:
    """Publish the files below ``data_path`` without those ``removed``, as the
    version after ``seen`` (the newest, if not given); returns its number."""
    added = files_of(spark.read.schema(schema).parquet(data_path)) if data_path else []
    version = (current(spark, path)[0] if seen is None else seen) + 1
    rows = [(f, True) for f in added] + [(f, False) for f in removed] + [(None, True)]
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/log/version={version}")
    return version
