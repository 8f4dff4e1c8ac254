"""Properties on the sf0.001 case log, and the import date
parser against Python's own strptime loop."""

import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from caseloom.functions.dates import parse_case_date
from caseloom.functions.text import present
from caseloom.operators import ingest, report
from caseloom.sources import driver_tables as dtab
from caseloom.sources.importer import select_import_columns

from conftest import SF001


def test_breakdown_sums_and_shares(spark):
    cases = dtab.cases_view(spark, SF001)
    issues = report.by_issues(cases, group_by=())
    assert issues.agg(F.sum("count")).first()[0] == cases.filter(present("issues")).count()
    shares = report.with_share(report.with_rank(report.report_all(cases)))
    sums = shares.groupBy("location", "dimension").agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 100.0) <= 0.05 * r.n + 1e-6 for r in sums)  # each share rounds by at most 0.05
    ranks = shares.groupBy("location", "dimension").agg(F.count("*").alias("n"), F.max("rank").alias("m"),
                                                        F.countDistinct("rank").alias("d")).collect()
    assert all(r.n == r.m == r.d for r in ranks)


def test_summary_bounds(spark):
    for r in report.report_summary(dtab.cases_view(spark, SF001)).collect():
        assert r.total >= r.completed + r.in_progress and 0 <= r.completion_rate <= 100


def test_import_partitions_every_row(spark):
    raw = dtab.import_raw_view(spark, SF001)
    cleaned = ingest.clean_case_rows(select_import_columns(raw))
    n_acc, n_rej = ingest.accepted(cleaned).count(), ingest.rejected(cleaned).count()
    assert n_acc + n_rej == raw.count()


PY_FORMATS = ["%Y-%m-%d", "%d-%b-%y", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"]


def _py_parse(text):
    for fmt in PY_FORMATS:
        try:
            return dt.datetime.strptime(text, fmt).date()
        except ValueError:
            continue
    return None


def _render(d, fmt, pad):
    day = f"{d.day:02d}" if pad else str(d.day)
    mon = f"{d.month:02d}" if pad else str(d.month)
    return {"iso": f"{d.year:04d}-{mon}-{day}", "dmy_name": f"{day}-{d.strftime('%b')}-{d.year % 100:02d}",
            "dmy_slash": f"{day}/{mon}/{d.year:04d}", "mdy_slash": f"{mon}/{day}/{d.year:04d}",
            "dmy_dash": f"{day}-{mon}-{d.year:04d}"}[fmt]


cells = st.one_of(
    st.builds(_render, st.dates(dt.date(1950, 1, 1), dt.date(2060, 12, 31)),
              st.sampled_from(["iso", "dmy_name", "dmy_slash", "mdy_slash", "dmy_dash"]), st.booleans()),
    st.sampled_from(["garbage", "31-2-2025", "2025-13-01", "5-Sept-25", "1/1/25", "", "2025-01-05 10:00"]),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(cells, min_size=50, max_size=200))
def test_parse_case_date_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.d for r in df.select("i", parse_case_date("t").alias("d")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _py_parse(t), t
