import datetime as dt

from pyspark.sql import types as T

from caseloom.operators import ingest
from caseloom.sources.importer import select_import_columns

HEADERS = ["No.", "Date", "Issues", "Description", "Step to Resolve", "Opened by", "Department", "Status",
           "Resolved by", "Remark", "Extra"]


def _sheet(spark, rows, headers=HEADERS):
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    return spark.createDataFrame(rows, schema)


def _row(no, date, data=True, status="Completed"):
    filled = ["Printer Issues", "desc", "step", "alice", "IT"] if data else ["", "  ", None, "\t", ""]
    return [no, date, *filled, status, "a1", None, "junk"]


FIXTURE = [
    _row("1", "2025-01-05"),
    _row("2.0", "5-Jan-25"),
    _row("3", "01/02/2025"),
    _row("4", "12/31/2025"),
    _row("5", "5-1-2025"),
    _row("6", "5-Jan-75"),
    _row("7", "garbage"),
    _row("8", "2025-01-05", data=False),
    _row("9", None, data=False),
    _row("0", "2025-01-05"),
    _row(None, "2025-01-05"),
    _row("10", "5-jan-01", status=None),
]


def test_import_fixture(spark):
    cleaned = ingest.clean_case_rows(select_import_columns(_sheet(spark, FIXTURE)))
    got = {r.case_no: r.case_date for r in ingest.accepted(cleaned).collect()}
    assert got == {
        "1": dt.date(2025, 1, 5), "2": dt.date(2025, 1, 5), "3": dt.date(2025, 2, 1),
        "4": dt.date(2025, 12, 31), "5": dt.date(2025, 1, 5), "6": dt.date(1975, 1, 5),
        "7": None, "8": dt.date(2025, 1, 5), "10": dt.date(2001, 1, 5),
    }
    reasons = {r.case_no: r.reject_reason for r in ingest.rejected(cleaned).collect()}
    assert reasons == {"9": "no_data", "0": "empty_case_no", None: "null_case_no"}
    counts = ingest.import_counts(cleaned).collect()[0]
    assert (counts.inserted, counts.skipped) == (9, 2)
    # a blank Status cell stays NULL when the sheet has a Status column
    status = {r.case_no: r.status for r in ingest.accepted(cleaned).collect()}
    assert status["10"] is None and status["1"] == "Completed"
    assert "Extra" not in cleaned.columns


def test_status_default_only_without_column(spark):
    headers = [h for h in HEADERS if h != "Status"]
    rows = [[v for h, v in zip(HEADERS, r) if h != "Status"] for r in FIXTURE[:2]]
    cleaned = ingest.clean_case_rows(select_import_columns(_sheet(spark, rows, headers)))
    assert {r.status for r in ingest.accepted(cleaned).collect()} == {"In progress"}


def test_missing_case_no_column_rejects_all(spark):
    headers = [h for h in HEADERS if h != "No."]
    rows = [[v for h, v in zip(HEADERS, r) if h != "No."] for r in FIXTURE[:3]]
    cleaned = ingest.clean_case_rows(select_import_columns(_sheet(spark, rows, headers)))
    c = ingest.import_counts(cleaned).collect()[0]
    assert (c.inserted, c.skipped) == (0, 3)


def test_observed_counts_single_pass(spark, tmp_dir):
    cleaned = ingest.clean_case_rows(select_import_columns(_sheet(spark, FIXTURE)))
    df, obs = ingest.observed_counts(cleaned)
    df.write.mode("overwrite").parquet(tmp_dir + "/out")
    assert obs.get == {"inserted": 9, "skipped": 2}


def test_import_into_appends_and_counts(spark, tmp_dir):
    from pyspark.sql import functions as F

    from caseloom.sources.cases import scan_cases
    rows = [r + [i] for i, r in enumerate(FIXTURE)]
    sheet = _sheet(spark, rows, HEADERS + ["_row"])
    path = tmp_dir + "/cases"
    c1 = ingest.import_into(select_import_columns(sheet), "s1", path, as_of=dt.datetime(2025, 1, 1))
    c2 = ingest.import_into(select_import_columns(sheet), "s2", path, as_of=dt.datetime(2025, 1, 2))
    assert c1 == c2 == {"inserted": 9, "skipped": 2}
    table = scan_cases(spark, path)
    assert sorted(r.id for r in table.collect()) == list(range(1, 19))
    assert table.filter(F.col("location") == "s2").agg(F.min("id")).first()[0] == 10


def test_width_check_is_optional(spark):
    from caseloom.schema import CASE_TEXT_LIMITS
    rows = FIXTURE[:2] + [_row("99", "2025-01-05", status="x" * 51)]
    mapped = select_import_columns(_sheet(spark, rows))
    assert ingest.accepted(ingest.clean_case_rows(mapped)).count() == 3
    checked = ingest.clean_case_rows(mapped, max_lengths=CASE_TEXT_LIMITS)
    assert {r.case_no: r.reject_reason for r in ingest.rejected(checked).collect()} == {"99": "too_long"}
    assert ingest.import_counts(checked).first().skipped == 1


def test_csv_round_trip_is_lossless(spark, tmp_dir):
    from caseloom.sources.importer import read_import
    from caseloom.sources.sinks import export_cases

    rows = [("1", "line1\nline2"), ("2", "  padded  "), ("3", 'say "hi", ok'), ("4", ""), ("5", "back\\slash")]
    sheet = spark.createDataFrame(rows, "`No.` string, Description string")
    export_cases(sheet, tmp_dir + "/sheet")
    back = read_import(spark, tmp_dir + "/sheet", {"No.": "case_no", "Description": "description"})
    assert sorted((r.case_no, r.description or "") for r in back.collect()) == rows


def test_file_to_table(spark, tmp_dir):
    """An exported file is imported in its own row order, quotes, line breaks
    and padding included."""
    from caseloom.sources.cases import scan_cases
    from caseloom.sources.importer import read_import
    from caseloom.sources.sinks import export_cases

    texts = ["b\nreak", " pad ", 'q"uote', "a,comma"]
    sheet = spark.createDataFrame([(str(i + 1), "2025-01-05", t) for i, t in enumerate(texts)],
                                  "`No.` string, Date string, Description string").coalesce(1)
    export_cases(sheet, tmp_dir + "/sheet")
    mapped = read_import(spark, tmp_dir + "/sheet")
    assert ingest.import_into(mapped, "s1", tmp_dir + "/cases") == {"inserted": 4, "skipped": 0}
    rows = scan_cases(spark, tmp_dir + "/cases").orderBy("id").collect()
    assert [(r.id, r.description) for r in rows] == list(zip(range(1, 5), texts))


def test_a_large_site_is_exported_and_imported_by_many_tasks(spark, tmp_dir):
    from pyspark.sql import functions as F

    from caseloom.operators.export import export_rows
    from caseloom.schema import CASES
    from caseloom.sources.importer import read_import
    from caseloom.sources.sinks import export_cases

    n = 3000
    text = lambda c: F.lit(c).alias(c)
    cases = spark.range(n).select((F.col("id") * 7 % n).alias("id"), *[
        F.lit(dt.date(2025, 1, 5)).alias("case_date") if f.name == "case_date" else
        F.concat(F.lit("row\n"), (F.col("id") * 7 % n).cast("string")).alias("description") if f.name == "description" else
        F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("location") if f.name == "location" else
        F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("created_at", "updated_at") else text(f.name)
        for f in CASES.fields if f.name != "id"]).select(*[f.name for f in CASES.fields])
    export_cases(export_rows(cases), tmp_dir + "/sheet", file_rows=100)
    back = read_import(spark, tmp_dir + "/sheet")
    rows = back.filter("location = 'large'").orderBy("_row").collect()
    assert [r.case_no for r in rows] == [str(i + 1) for i in range(len(rows))] and len(rows) == n * 99 // 100
    assert len({r._row.file for r in rows}) == 30
    ids = [int(r.description.split("\n")[1]) for r in rows]
    assert ids == sorted(ids)


def test_import_scans_the_sheet_once(spark, tmp_dir):
    """An accumulator in the source counts the rows that the import reads."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)
    rows = [r + [i] for i, r in enumerate(FIXTURE)]
    sheet = _sheet(spark, rows, HEADERS + ["_row"])

    def count(place):
        seen.add(1)
        return place

    counted = F.udf(count, "string").asNondeterministic()
    mapped = select_import_columns(sheet.withColumn("_row", counted("_row").cast("int")))
    assert ingest.import_into(mapped, "s1", tmp_dir + "/cases") == {"inserted": 9, "skipped": 2}
    assert seen.value == len(FIXTURE)
