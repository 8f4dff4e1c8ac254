"""Helpers shared by the operators: words, hashes, written intermediates."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white space characters.
WORD = "[^\\x20\\x09-\\x0D]+"

M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only where it is
    unset on a local master (tests) a temporary folder takes its place."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-ck-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, a
    lost executor costs no recomputation, and every later read sees the same
    rows.  The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows of a batch that a Python worker gets at once, where the session
    leaves that at Spark's default: whole texts are wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on a uint64 array (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """1, P, P^2, ... as wrapping uint64."""
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(max(n, 4096), 0x9E3779B97F4A7C15, dtype=np.uint64)
        factors[0] = 1
        _POWERS = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[:n]


#: A random-looking value for each byte.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hash of every word of a text, in order."""
    raw = np.frombuffer(("" if text is None else text).encode("utf-8"), dtype=np.uint8)
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    at = np.flatnonzero(solid)
    into = at - np.repeat(start, length)
    first = np.cumsum(length) - length
    sums = np.add.reduceat(_BYTE[raw[at]] * powers(int(length.max()))[into], first)
    return mix64(sums + length.astype(np.uint64))


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of k consecutive elements (empty if too few)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, seed, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix64(out)
