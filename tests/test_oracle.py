"""Every registered query against its DuckDB oracle (sf0.001 here; the
driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from caseloom import registry
from oracle import compare, duck

from conftest import SF001

SQLS = registry.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(SQLS) <= set(entry.oracle_sql())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    problems, _ = compare(df, con, SQLS[name])
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["location", "name", "count", "rank", "share", "bar"]


@pytest.mark.parametrize("name", ["users_with_sites", "cases_after_changes", "latest_valid", "resolvers_as_of",
                                  "lockout_audit", "case_list_newest"])
def test_time_zone_independent(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Bangkok")
    try:
        problems, _ = compare(entry.queries()[name](spark, SF001), con, SQLS[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert not problems, problems
