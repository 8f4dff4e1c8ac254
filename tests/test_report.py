import pytest
import datetime as dt

from pyspark.sql import functions as F

from caseloom.operators import report
from caseloom.operators.filters import CaseFilter
from caseloom.schema import CASES


def _cases(spark):
    d = dt.date
    rows = [
        (1, "9", d(2025, 1, 31), "Printer Issues", "50% off", "restart", "op", "IT", "Completed", "a1, b2", None, None, None, "s1"),
        (2, "10", d(2025, 2, 1), "Printer Issues", "a_b", "step", "op", "it", "In progress", "a1,a1", None, None, None, "s1"),
        (3, "X-7", d(2025, 2, 28), "", "back\\slash", "step", "op", "  ", "Pending", "--- Please Select ---", None, None, None, "s1"),
        (4, None, None, "TV Issues", "x" * 30, "only-in-steps", "op", None, None, ",\tb2 ,", None, None, None, "s1"),
        (5, "007", d(2025, 2, 1), "OPERA Issues", "y" * 31, "step", "op", "Finance", "Completed", "A1", None, None, None, "s2"),
        (6, "11", d(2024, 2, 1), "OPERA Issues", "z", "step", "op", "Finance", "Completed", None, None, None, None, "s2"),
    ]
    return spark.createDataFrame(rows, CASES)


def test_resolver_split_trim_placeholders(spark):
    got = {(r.location, r.name): r["count"] for r in report.by_resolver(_cases(spark)).collect()}
    assert got == {("s1", "a1"): 3, ("s1", "b2"): 2, ("s2", "A1"): 1}


def test_breakdowns_and_present(spark):
    df = _cases(spark)
    issues = {(r.location, r.name): r["count"] for r in report.by_issues(df).collect()}
    assert issues == {("s1", "Printer Issues"): 2, ("s1", "TV Issues"): 1, ("s2", "OPERA Issues"): 2}
    dept = {(r.location, r.name): r["count"] for r in report.by_department(df).collect()}
    assert ("s1", "  ") in dept  # F4 is "not NULL and not ''", as in the SQL
    assert sum(r["count"] for r in report.by_issues(df, group_by=()).collect()) == 5


def test_kpi_this_month_is_a_range(spark):
    df = _cases(spark)
    kpi = {r.location: r for r in report.stats_kpi(df, dt.date(2025, 2, 15)).collect()}
    assert kpi["s1"].this_month == 2 and kpi["s2"].this_month == 1  # 2024-02 is not this month
    assert kpi["s1"].total == 4 and kpi["s1"].completed == 1 and kpi["s1"].in_progress == 1


def test_report_summary_half_up(spark):
    rows = [(i, "Completed" if i < 23 else "In progress") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, status string")
    r = report.report_summary(df, group_by=()).collect()[0]
    assert r.completion_rate == 58  # 23/40 = 57.5 -> 58 (exact half-up)
    empty = report.report_summary(df.filter("id < 0"), group_by=()).collect()
    assert empty == [] or empty[0].completion_rate == 0


def test_report_all_single_scan_matches_parts(spark):
    df = _cases(spark)
    allb = report.report_all(df)
    parts = {"issues": report.by_issues(df), "department": report.by_department(df),
             "resolver": report.by_resolver(df),
             "date": report.by_date(df).select("location", F.col("date").cast("string").alias("name"), "count")}
    for dim, part in parts.items():
        a = {(r.location, r.name, r["count"]) for r in allb.filter(F.col("dimension") == dim).collect()}
        b = {(r.location, r.name, r["count"]) for r in part.collect()}
        assert a == b, dim
    plan = allb._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1


def test_rank_share_top(spark, numbering_path):
    df = _cases(spark)
    bd = report.with_share(report.with_rank(report.report_all(df)))
    s1 = {r.name: r for r in bd.filter("location = 's1' AND dimension = 'resolver'").collect()}
    assert (s1["a1"].rank, s1["b2"].rank) == (1, 2)
    assert s1["a1"].share == 60.0 and s1["b2"].share == 40.0 and s1["b2"].bar == pytest.approx(200 / 3)
    top = report.top_n(report.report_all(df), n=1)
    assert top.filter("location = 's1' AND dimension = 'issues'").collect()[0].name == "Printer Issues"


def test_search_literal_vs_pattern(spark):
    df = _cases(spark)
    assert CaseFilter(search="50%").apply(df).count() == 1
    assert CaseFilter(search="a_b").apply(df).count() == 1
    assert CaseFilter(search="a%b", search_pattern=True).apply(df).count() == 1
    assert CaseFilter(search="back\\slash").apply(df).count() == 1
    assert CaseFilter(search="only-in-steps").apply(df).count() == 1
    assert CaseFilter(search="only-in-steps").for_stats().apply(df).count() == 0


def test_facets_sorted_distinct(spark):
    vals = [r.value for r in report.facet(_cases(spark), "issues", group_by=()).collect()]
    assert vals == ["OPERA Issues", "Printer Issues", "TV Issues"]


def test_trend_ranked_by_day_bar_from_first_day(spark, numbering_path):
    df = _cases(spark)
    out = report.with_share(report.with_rank(report.report_all(df)))
    s1 = [(r.name, r["count"], r["rank"], r.bar) for r in
          out.filter("location = 's1' AND dimension = 'date'").orderBy("rank").collect()]
    assert s1 == [("2025-01-31", 1, 1, 100.0), ("2025-02-01", 1, 2, 100.0), ("2025-02-28", 1, 3, 100.0)]
    s2 = [(r.name, r["count"], r["rank"], r.bar) for r in
          out.filter("location = 's2' AND dimension = 'date'").orderBy("rank").collect()]
    assert [x[0] for x in s2] == ["2024-02-01", "2025-02-01"]
    top = report.top_n(report.report_all(df))
    assert top.filter("dimension = 'date'").count() == 0


def test_case_insensitive_collation(spark):
    df = _cases(spark)
    binary = {(r.location, r.name): r["count"] for r in report.by_department(df).collect()}
    assert binary[("s1", "IT")] == 1 and binary[("s1", "it")] == 1 and ("s1", "  ") in binary
    ci = {(r.location, r.name): r["count"] for r in report.by_department(df, collation="ci").collect()}
    assert ci == {("s1", "IT"): 2, ("s2", "Finance"): 2}
    assert [r.value for r in report.facet(df, "department", group_by=(), collation="ci").collect()] == ["Finance", "IT"]


def test_like_pattern_backslashes(spark):
    from caseloom.operators.filters import like_pattern
    assert like_pattern("a%b") == "%a%b%"
    assert like_pattern("50\\%") == "%50\\%%"
    assert like_pattern("back\\slash") == "%backslash%"      # \s stands for s
    assert like_pattern("end\\") == "%end\\\\%"              # trailing backslash is literal
    df = _cases(spark)
    for term, n in [("back\\\\slash", 1), ("50\\%", 1), ("a\\_b", 1), ("end\\", 0), ("x\\y", 0)]:
        assert CaseFilter(search=term, search_pattern=True).apply(df).count() == n, term


def test_collations(spark):
    from caseloom.operators.filters import CaseFilter, search

    words = ["IT", "it ", "It", "Café", "CAFE ", "cafe", "Caf", None, "  "]
    df = spark.createDataFrame([(w, "s") for w in words], "department string, location string")
    count = lambda c: sorted((r.name, r["count"]) for r in report.by_department(df, collation=c).collect())
    assert count("ai") == [("CAFE ", 3), ("Caf", 1), ("IT", 3)]
    assert count("ci") == [("CAFE ", 2), ("Caf", 1), ("Café", 1), ("IT", 3)]
    pick = lambda **kw: sorted(r.department for r in CaseFilter(**kw).apply(df).collect())
    assert pick(department="cÀfE", collation="ai") == ["CAFE ", "Café", "cafe"]
    assert sorted(r.department for r in df.filter(search("FÉ", ("department",), collation="ai")).collect()) == ["CAFE ", "Café", "cafe"]
