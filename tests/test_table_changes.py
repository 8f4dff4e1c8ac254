import datetime as dt

from pyspark.sql import functions as F

from caseloom.operators import changes
from caseloom.sources import driver_tables as dtab
from caseloom.sources.cases import scan_cases
from caseloom.sources.sinks import append_cases
from caseloom.sources.table_changes import apply_changes_to_table, purge_site_table

from conftest import SF001

AS_OF = dt.datetime(2024, 2, 1)


def _key(df):
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(rows, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_table_changes_equal_the_batch_form(spark, tmp_dir):
    path = tmp_dir + "/cases"
    cases = dtab.cases_view(spark, SF001)
    append_cases(cases, path)
    ch = dtab.changes_with_site(spark, SF001)
    want = changes.apply_changes(scan_cases(spark, path), ch, AS_OF)
    want_rows = _key(want)
    touched = apply_changes_to_table(spark, path, ch, AS_OF)
    assert touched and set(touched) <= {"africa", "america", "asia", "europe", "middle east"}
    assert _key(scan_cases(spark, path)) == want_rows


def test_delete_last_rows_of_a_site_and_purge(spark, tmp_dir):
    path = tmp_dir + "/cases"
    cases = dtab.cases_view(spark, SF001)
    append_cases(cases.filter(F.col("location").isin("asia", "europe")), path)
    asia_ids = scan_cases(spark, path, "asia").select("id")
    dels = asia_ids.select("id", *[F.lit(None).cast("string").alias(c) for c in
                                   ("case_no", "issues", "description", "step_to_resolve", "opened_by",
                                    "department", "status", "resolved_by", "remark")],
                           F.lit(None).cast("date").alias("case_date"), F.lit("D").alias("op"),
                           F.lit(1).cast("long").alias("seq"), F.lit("asia").alias("location"))
    assert apply_changes_to_table(spark, path, dels, AS_OF) == {"asia": 0}
    assert scan_cases(spark, path, "asia").count() == 0
    n_europe = scan_cases(spark, path, "europe").count()
    assert purge_site_table(spark, path, "europe") == n_europe > 0
    assert scan_cases(spark, path).count() == 0


def test_insert_into_new_site_creates_partition(spark, tmp_dir):
    from caseloom import api
    path = tmp_dir + "/cases"
    cases = dtab.cases_view(spark, SF001)
    append_cases(cases.filter(F.col("location") == "asia"), path)
    n_asia = scan_cases(spark, path, "asia").count()
    rows = spark.createDataFrame([(10**9, "Printer Issues", "newsite"), (10**9 + 1, None, "newsite")],
                                 "id long, issues string, location string")
    ins = rows.select("id", *[F.lit(None).cast("string").alias(c) for c in
                              ("case_no", "description", "step_to_resolve", "opened_by", "department", "status",
                               "resolved_by", "remark")], "issues", F.lit(None).cast("date").alias("case_date"),
                      F.lit("I").alias("op"), F.lit(1).cast("long").alias("seq"), "location")
    assert api.commit_changes(spark, path, ins, AS_OF) == {"newsite": 2}
    new = {r.id: r.case_no for r in scan_cases(spark, path, "newsite").collect()}
    assert new == {10**9: "1", 10**9 + 1: "2"}
    assert scan_cases(spark, path, "asia").count() == n_asia


def test_sized_conf():
    from caseloom.session import sized_conf
    c = sized_conf(40 * 1024**4, 8000)
    assert c["spark.sql.shuffle.partitions"] == "163840" and c["spark.sql.adaptive.enabled"] == "true"
    assert sized_conf(10**6, 16)["spark.sql.shuffle.partitions"] == "32"  # at least two waves of cores


def test_purge_of_a_site_whose_code_needs_escaping(spark, tmp_dir):
    path = tmp_dir + "/cases"
    cases = dtab.cases_view(spark, SF001)
    append_cases(cases.filter(F.col("location").isin("asia", "europe")).withColumn("location", F.concat(F.lit("a=%/"), "location")), path)
    n = scan_cases(spark, path).count()
    gone = purge_site_table(spark, path, "a=%/asia")
    assert gone > 0 and scan_cases(spark, path).count() == n - gone
    assert scan_cases(spark, path, "a=%/asia").count() == 0


def _one(i, op, site, **kw):
    cols = ("case_no", "issues", "description", "step_to_resolve", "opened_by", "department", "status", "resolved_by", "remark")
    return [i, *[kw.get(c) for c in cols], None, op, 1, site]


CHANGE = ("id long, case_no string, issues string, description string, step_to_resolve string, opened_by string, department string, "
          "status string, resolved_by string, remark string, case_date date, op string, seq long, location string")


def _spread(spark, path):
    """A table of many files: several appends of every site."""
    cases = dtab.cases_view(spark, SF001)
    for k in range(4):
        append_cases(cases.filter(F.col("id") % 4 == k), path)
    return cases


def test_one_changed_row_replaces_one_file(spark, tmp_dir):
    from caseloom.sources import versions
    path = tmp_dir + "/cases"
    _spread(spark, path)
    version, before = versions.current(spark, path)
    row = scan_cases(spark, path, "asia").filter("id % 4 = 2").orderBy("id").first()
    rows = _key(scan_cases(spark, path).filter(F.col("id") != row.id))
    assert set(apply_changes_to_table(spark, path, spark.createDataFrame([_one(row.id, "U", "asia", remark="new")], CHANGE), AS_OF)) == {"asia"}
    after = versions.current(spark, path)
    assert after[0] == version + 1 and len(set(before) - set(after[1])) == 1 and len(set(after[1]) - set(before)) == 1
    got = scan_cases(spark, path)
    assert _key(got.filter(F.col("id") != row.id)) == rows
    changed = got.filter(F.col("id") == row.id).collect()
    assert [(r.remark, r.created_at, r.updated_at) for r in changed] == [("new", row.created_at, AS_OF)]
    # a new case alone replaces no file; an older version stays readable
    apply_changes_to_table(spark, path, spark.createDataFrame([_one(10**7, "I", "asia")], CHANGE), AS_OF)
    assert set(after[1]) < set(versions.current(spark, path)[1])
    assert scan_cases(spark, path, version=version).filter(F.col("id") == row.id).first() == row


def test_a_write_that_stops_halfway_is_not_seen(spark, tmp_dir):
    from caseloom.sources import versions
    from caseloom.sources.sinks import publish, write_case_files
    path = tmp_dir + "/cases"
    assert scan_cases(spark, path).count() == 0
    cases = _spread(spark, path)
    want = _key(scan_cases(spark, path))
    write_case_files(cases.limit(50), versions.new_data_path(path))  # data files without their log entry
    assert _key(scan_cases(spark, path)) == want
    publish(scan_cases(spark, path).filter("location = 'asia'"), path)  # replaces the table that it reads
    assert _key(scan_cases(spark, path)) == _key(scan_cases(spark, path, "asia")) and len(want) > scan_cases(spark, path).count() > 0


def test_two_writers_of_one_version(spark, tmp_dir):
    import pytest
    from pyspark.errors import AnalysisException
    from caseloom.sources import versions
    path = tmp_dir + "/cases"
    _spread(spark, path)
    seen = versions.current(spark, path)[0]
    versions.commit(spark, path, None, ["x"], seen=seen)
    with pytest.raises(AnalysisException):
        versions.commit(spark, path, None, ["y"], seen=seen)


def test_newest_snapshot_is_a_complete_one(spark, tmp_dir):
    from caseloom.sources.sinks import newest_snapshot, snapshot
    base = tmp_dir + "/snap"
    assert newest_snapshot(spark, base) == {}
    table = spark.range(5)
    first = snapshot({"a": table, "b": table}, base)
    assert newest_snapshot(spark, base) == first
    second = snapshot({"a": table, "b": table}, base)
    table.write.parquet(base + "/29990101T000000000000/a")  # a snapshot that stopped after its first table
    assert newest_snapshot(spark, base) == second != first


def test_point_lookup_skips_row_groups(spark, tmp_dir):
    """Ids spread over all dates: bloom filters leave the files without the
    id unread."""
    from caseloom.sources.cases import case_by_id
    path = tmp_dir + "/cases"
    cases = dtab.cases_view(spark, SF001)
    spread = cases.withColumn("id", F.xxhash64("id")).filter("location = 'asia'")
    for k in range(4):
        append_cases(spread.filter(F.pmod("id", F.lit(4)) == k), path)
    some = spread.orderBy("id").limit(100).collect()[50]

    def rows_read(df):
        found = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return len(found), leaves.apply(0).metrics().get("numOutputRows").get().value()

    n = scan_cases(spark, path, "asia").count()
    assert rows_read(case_by_id(spark, path, "asia", some.id))[0] == 1
    assert rows_read(case_by_id(spark, path, "asia", some.id))[1] <= n / 2
    assert rows_read(case_by_id(spark, path, "asia", some.id + 1)) == (0, 0)
