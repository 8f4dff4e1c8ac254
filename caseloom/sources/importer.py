"""S3: tabular import with a header map (unknown columns dropped, missing
columns NULL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.schema import EXPORT_HEADERS

DEFAULT_HEADER_MAP = {header: col for col, header in EXPORT_HEADERS}


def select_import_columns(raw: DataFrame, header_map: dict[str, str] | None = None,
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename by header, keep only mapped columns, add missing ones as NULL
    text.  ``status_given`` records whether the sheet had a Status column
    (the default status applies only when it did not).  Columns named in
    ``keep`` (and ``_``-prefixed ones) pass through unchanged."""
    header_map = header_map or DEFAULT_HEADER_MAP
    present_cols = set(raw.columns)
    out = []
    for header, col in header_map.items():
        if header in present_cols:
            out.append(F.col(f"`{header}`").cast("string").alias(col))
        else:
            out.append(F.lit(None).cast("string").alias(col))
    status_header = next((h for h, c in header_map.items() if c == "status"), None)
    out.append(F.lit(status_header in present_cols).alias("status_given"))
    case_no_header = next((h for h, c in header_map.items() if c == "case_no"), None)
    out.append(F.lit(case_no_header in present_cols).alias("case_no_given"))
    extra = [c for c in raw.columns if c.startswith("_") or c in keep]
    out.extend(F.col(c) for c in extra)
    return raw.select(*out)


def read_import(spark: SparkSession, path: str, header_map: dict[str, str] | None = None,
                fmt: str = "csv", keep: tuple[str, ...] = ("location",)) -> DataFrame:
    """Read an import file with every cell as text (partition folders such
    as ``location=...`` stay text too), then map the headers.  ``_row`` orders
    the rows as they stand in the source: by file, block and place.  Quoted
    cells may hold line breaks, so a CSV file is one task; an export is made
    of bounded files."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("place")).alias("_row")
    if fmt == "csv":
        raw = (spark.read.options(header=True, inferSchema=False, recursiveFileLookup=False, multiLine=True, escape='"',
                                  ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
        raw = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns], place)
    else:
        raw = spark.read.format(fmt).load(path)
        raw = raw.select("*", place)
    return select_import_columns(raw, header_map, keep)
