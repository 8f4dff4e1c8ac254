"""F3 at rest: a trigram index of the stored case table's files.

``index/grams/part=<id>/`` holds one row for each (trigram, data file) pair,
range partitioned and sorted by trigram, so a lookup of a few trigrams reads a
few row groups.  ``index/files/part=<id>/`` names the files indexed that way
and is written last.  Data files never change (``sources.versions``), so an
entry never goes stale: files of older versions are left out by the table's
own file list, and files that are not indexed yet are always read.

A trigram is three code points in a row of a searched column, in lower case
and with both small sigmas as one (lower case of a sigma goes by its place in
the word; that of any other letter does not).  Whatever holds a text of three
or more characters, in the same or another letter case, then holds its
trigrams; the exact predicate is applied to the files that are left.  Shorter
texts, patterns without three plain characters in a row and the accent
insensitive collation, where a letter can equal several, read all files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.operators.filters import LIST_SEARCH_COLUMNS, CaseFilter, plain_parts
from caseloom.schema import CASES
from caseloom.sources import versions

GRAMS, FILES = "gram string, file string", "file string"
_LENGTH, _MOST = 3, 2**30
#: Trigrams of a term that are looked up, spread over it: Spark compares up to so many with a row group one by one.
LOOKED_UP = 10


def _folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ς", "σ")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, none for NULL or a shorter one; in
    time linear in its length."""
    chars = F.split(_folded(F.coalesce(text, F.lit(""))), "")
    shifted = F.arrays_zip(chars, F.slice(chars, 2, F.lit(_MOST)), F.slice(chars, 3, F.lit(_MOST)))
    # the last two have no right neighbours: NULL
    return F.array_distinct(F.array_compact(F.transform(shifted, lambda z: F.concat(z["0"], z["1"], z["2"]))))


def _file_of(uri: Column) -> Column:
    """``versions.relative`` as an expression."""
    return F.concat(F.lit("commit="), F.url_decode(F.replace(F.substring_index(uri, "/data/commit=", -1), F.lit("+"), F.lit("%2B"))))


def _at(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/index/{name}"


def indexed_files(spark: SparkSession, path: str) -> set[str]:
    """The data files that the index covers."""
    found = versions.read_or_none(spark, _at(path, "files"), FILES)
    return {r.file for r in found.distinct().collect()} if found is not None else set()


def index_terms(spark: SparkSession, path: str) -> int:
    """Index the files of the newest version that are not indexed yet; returns
    how many.  A run that stops halfway covers no file, and the next one does
    them again."""
    files = sorted(set(versions.current(spark, path)[1]) - indexed_files(spark, path))
    if not files:
        return 0
    base, part = f"{path.rstrip('/')}/data", f"part={uuid.uuid4().hex}"
    rows = spark.read.schema(CASES).option("basePath", base).parquet(*[f"{base}/{f}" for f in files])
    found = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in LIST_SEARCH_COLUMNS])))
    # combined before the shuffle: at most one row a trigram, file and task
    grams = rows.select(F.explode(found).alias("gram"), F.col("_metadata.file_path").alias("uri")).distinct()
    grams = grams.select("gram", _file_of(F.col("uri")).alias("file"))
    grams.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.parquet(f"{_at(path, 'grams')}/{part}")
    spark.createDataFrame([(f,) for f in files], FILES).coalesce(1).write.parquet(f"{_at(path, 'files')}/{part}")
    return len(files)


def term_grams(spark: SparkSession, term: str, pattern: bool = False, collation: str | None = None) -> list[str]:
    """Trigrams that every text has which ``filters.search`` finds; none where
    it can find a text without any."""
    if collation == "ai":
        return []
    parts = plain_parts(term) if pattern else [term]
    if not any(len(p) >= _LENGTH for p in parts):
        return []
    grams = F.array_distinct(F.flatten(F.transform(F.col("parts"), trigrams)))
    return spark.createDataFrame([([p.lower() if collation else p for p in parts],)], "parts array<string>").select(grams).first()[0]


def files_with_term(spark: SparkSession, path: str, files: list[str], term: str, pattern: bool = False, collation: str | None = None) -> list[str]:
    """Those of ``files`` that can hold a match.  The trigrams reach the scan
    of the index as a pushed filter; one row a candidate file comes back, and
    the file list is on the driver already."""
    wanted = term_grams(spark, term, pattern, collation)
    wanted = [wanted[i * len(wanted) // LOOKED_UP] for i in range(LOOKED_UP)] if len(wanted) > LOOKED_UP else wanted
    index = versions.read_or_none(spark, _at(path, "grams"), GRAMS) if wanted else None
    if index is None:
        return files
    covered = indexed_files(spark, path)
    hits = (index.filter(F.col("gram").isin(wanted)).groupBy("file").agg(F.count_distinct("gram").alias("n"))
            .filter(F.col("n") == F.lit(len(wanted))).collect())
    held = {r.file for r in hits}
    return [f for f in files if f not in covered or f in held]


def search_cases(spark: SparkSession, path: str, flt: CaseFilter, version: int | None = None) -> DataFrame:
    """The stored cases that ``flt`` takes.  Its search term leaves out files
    by the index, site and date prune partitions and row groups, and the whole
    filter decides on the rows."""
    files = versions.current(spark, path, version)[1]
    if flt.search and set(flt.search_columns) <= set(LIST_SEARCH_COLUMNS):
        files = files_with_term(spark, path, files, flt.search, flt.search_pattern, flt.collation)
    return flt.apply(versions.read_files(spark, path, CASES, files))
