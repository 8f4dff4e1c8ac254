import datetime as dt

import pytest

from pyspark.sql import functions as F

from caseloom import api
from caseloom.operators.filters import CaseFilter

from test_access_admin import _dims
from test_report import _cases


def _who(spark, uid):
    users, grants, locs = _dims(spark)
    return api.Access(users, grants, locs, uid)


def test_list_respects_access_and_limit(spark):
    cases = _cases(spark)
    page, total = api.list_cases(cases, _who(spark, 3), "s1", limit="2")
    assert [r.id for r in page.collect()] == [4, 3] and total.first().total == 4
    page, total = api.list_cases(cases, _who(spark, 3), "s2")   # no grant on s2
    assert page.count() == 0 and total.first().total == 0
    page, _ = api.list_cases(cases, _who(spark, 1), "s2", limit="x")  # superadmin; limit not digits
    assert [(r.id, r.case_date) for r in page.collect()] == [(6, "2024-02-01"), (5, "2025-02-01")]


def test_report_request_shapes(spark):
    out = api.report_request(_cases(spark), _who(spark, 2), "s1", CaseFilter(from_date="2025-01-01"))
    s = out["summary"].first()
    assert (s.total, s.completed, s.in_progress, s.completion_rate) == (3, 1, 1, 33)
    res = {r.name: (r["count"], r["rank"], r.share) for r in
           out["breakdowns"].filter(F.col("dimension") == "resolver").collect()}
    assert res == {"a1": (3, 1, 75.0), "b2": (1, 2, 25.0)}
    assert out["top"].filter(F.col("rank") > 5).count() == 0


def test_stats_facets_export(spark):
    cases = _cases(spark)
    st = api.stats(cases, None, "s1", CaseFilter(status="Completed"), dt.date(2025, 2, 15)).first()
    assert st.total == 4  # status ignored by the panel
    depts, issues = api.facets(cases, None, "s1")
    assert [r.value for r in issues.collect()] == ["Printer Issues", "TV Issues"]
    sheet, widths = api.export_sheet(cases, None, "s1")
    assert [r["No."] for r in sheet.collect()] == [1, 2, 3, 4]
    assert {r.column: r.width for r in widths.collect()}["No."] == 5
    assert api.max_no(cases, "s1").first().max_no == 10


def test_case_changes(spark):
    cases = _cases(spark)
    new = spark.createDataFrame([(100, "s2", "Printer Issues")], "id long, location string, issues string")
    out = api.create_cases(cases, new, dt.datetime(2025, 3, 1))
    row = out.filter("id = 100").first()
    assert (row.case_no, row.status, row.description) == ("12", "In progress", "")
    out = api.delete_cases(out, spark.createDataFrame([(1, "s1"), (100, "s2"), (2, "s2")], "id long, location string"), dt.datetime(2025, 3, 2))
    assert sorted(r.id for r in out.collect()) == [2, 3, 4, 5, 6]


def test_login_sites(spark):
    users, grants, locs = _dims(spark)
    root = [(r.code, r.can_delete) for r in api.login_sites(users, grants, locs, 1).collect()]
    assert root == [("s3", True), ("s1", True), ("s2", True)]  # ordered by name: Empty, Site One, Site Two
    u3 = [(r.code, r.can_view, r.can_edit) for r in api.login_sites(users, grants, locs, 3).collect()]
    assert u3 == [("s1", True, False)]


def test_max_no_zero_when_none(spark):
    cases = _cases(spark).filter("id <> 5 AND id <> 6")  # s2 left with no rows at all
    assert api.max_no(cases, "s2").first().max_no == 0
    only_text = _cases(spark).withColumn("case_no", F.lit("X-1"))
    assert api.max_no(only_text, "s1").first().max_no == 0


def test_empty_site_requests(spark):
    cases = _cases(spark)
    page, total = api.list_cases(cases, None, "nowhere")
    assert page.count() == 0 and total.first().total == 0
    out = api.report_request(cases, None, "nowhere")
    s = out["summary"].first()
    assert (s.total, s.completion_rate) == (0, 0)
    assert out["breakdowns"].count() == 0 and out["top"].count() == 0
    sheet, widths = api.export_sheet(cases, None, "nowhere")
    assert sheet.count() == 0
    assert {r.column: r.width for r in widths.collect()}["Step to Resolve"] == len("Step to Resolve") + 2
    assert api.stats(cases, None, "nowhere", CaseFilter(), dt.date(2025, 1, 1)).first().total == 0


def test_writes_need_the_right(spark):
    """Changes that the user may not make change nothing."""
    cases = _cases(spark)
    users, grants, locs = _dims(spark)
    grants = spark.createDataFrame([(3, "s1", True, True, False)], grants.schema)
    who = api.Access(users, grants, locs, 3)
    ids = "id long, location string"
    as_of = dt.datetime(2025, 3, 1)
    before = sorted((r.id, r.location) for r in cases.collect())
    out = api.delete_cases(cases, spark.createDataFrame([(1, "s1"), (5, "s2")], ids), as_of, who)
    assert sorted((r.id, r.location) for r in out.collect()) == before
    new = spark.createDataFrame([(100, "s1"), (101, "s2")], ids)
    out = api.create_cases(cases, new, as_of, who)
    assert sorted((r.id, r.location) for r in out.collect()) == sorted(before + [(100, "s1")])
    with pytest.raises(PermissionError):
        api.import_sheet(new, "s2", "unused", who=who)


def test_guards_of_lookup_max_number_and_purge(spark):
    cases = _cases(spark)
    assert [r.id for r in api.case(cases, _who(spark, 3), "s1", 4).collect()] == [4]
    assert api.case(cases, _who(spark, 3), "s2", 5).count() == 0  # no grant on s2
    assert api.max_no(cases, "s1", _who(spark, 3)).first().max_no == 10
    assert api.max_no(cases, "s2", _who(spark, 3)).first().max_no == 0
    with pytest.raises(PermissionError):
        api.purge(cases, "s2", _who(spark, 3))
    kept, gone = api.purge(cases, "s2", _who(spark, 1))
    assert kept.filter("location = 's2'").count() == 0 and gone.first().purged > 0
