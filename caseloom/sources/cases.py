"""The case fact table and the dimension tables at rest.

At rest the case log is ONE Parquet table partitioned by ``location``, read
through its newest published version (``sources.versions``); a site is a
partition, so a per-site read prunes files instead of scanning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caseloom.schema import CASES, GRANTS, LOCATIONS, STORED_USERS
from caseloom.sources import versions


def scan_cases(spark: SparkSession, path: str, site: str | None = None, version: int | None = None) -> DataFrame:
    """Read the case log with its explicit schema (a digit-only site
    code must stay a string, which inference would not keep); ``site``
    becomes a partition filter.  A table without any version has no rows."""
    df = versions.read_files(spark, path, CASES, versions.current(spark, path, version)[1])
    if site is not None:
        df = df.filter(F.col("location") == F.lit(site))
    return df


def case_by_id(spark: SparkSession, path: str, site: str | None, case_id: int) -> DataFrame:
    """F7 on the stored table: one case by site and id (None: the cases of
    that id in all sites).  The site prunes partitions, the id row groups by
    their bloom filters."""
    return scan_cases(spark, path, site).filter(F.col("id") == F.lit(case_id))


def union_sites(per_site: dict[str, DataFrame]) -> DataFrame:
    """One logical fact from per-site tables of identical schema."""
    parts = [df.withColumn("location", F.lit(code)) for code, df in sorted(per_site.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_site_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """S2 migration: per-site case tables (one path per site code, each
    without a site column) read with the case schema and united into one
    fact with ``location``; write it with ``sinks.append_cases``."""
    schema = T.StructType([f for f in CASES.fields if f.name != "location"])
    return union_sites({code: spark.read.schema(schema).parquet(p) for code, p in paths.items()})


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """The site dimension."""
    return spark.read.schema(LOCATIONS).parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """The user dimension (no password column is ever read)."""
    return spark.read.schema(STORED_USERS).parquet(path)


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    """Site grants (user_id, location_code, can_view, can_edit, can_delete)."""
    return spark.read.schema(GRANTS).parquet(path)


def sites_by_name(locations: DataFrame) -> DataFrame:
    """S8 listing: code, name, short_name ordered by name."""
    return locations.select("code", "name", "short_name").orderBy("name", "code")
