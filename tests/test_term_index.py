"""The trigram index of the stored table: equal rows, fewer files."""

import pytest
from pyspark.sql import functions as F

from caseloom import api
from caseloom.operators.filters import CaseFilter, plain_parts, search
from caseloom.sources import driver_tables as dtab, term_index, versions
from caseloom.sources.cases import scan_cases
from caseloom.sources.sinks import append_cases

from conftest import SF001


TEXTS = [  # (description, site): one file a site; the last two are left out of the index
    ("Printer jam on floor 3", "s0"), ("ΟΔΟΣ and ΣΟΦΟΣ", "s1"), ("100% of disk_full \\ here", "a=%/b +c"),
    ("ÉCRAN café", "s3"), (None, "s4"), ("", "s5"), ("😀😀😀 emoji", "s6"), ("x" * 50_000 + "needle", "s7"),
    ("printer late", "s0"), ("ab", "s1"),
]


def _rows(spark, texts, first):
    df = spark.createDataFrame([(first + i, t, s) for i, (t, s) in enumerate(texts)], "id long, description string, location string")
    names = [f.name for f in term_index.CASES.fields]
    types = {f.name: f.dataType for f in term_index.CASES.fields}
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(types[n]).alias(n) for n in names])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("terms") / "cases")
    append_cases(_rows(spark, TEXTS[:-2], 0), path)
    assert term_index.index_terms(spark, path) == len(TEXTS) - 2
    assert term_index.index_terms(spark, path) == 0
    append_cases(_rows(spark, TEXTS[-2:], len(TEXTS) - 2), path)
    return path


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


TERMS = ["Printer", "PRINTER", "ΟΔΟΣ", "οδος", "οδοσ", "ΟΦΟ", "ab", "needle", "😀😀😀", "écran", "ÉCRAN", "no such text", "100%", "xxx", "\\ h"]
PATTERNS = ["Pri_ter%floor", "%disk\\_full%", "100\\% of", "%%", "k\\", "Σ_Φ", "x%needle", "a\\b"]


def test_no_file_with_a_match_is_skipped(spark, table):
    """Every term in every mode: the rows found by the exact predicate on the
    whole table lie in files that the index leaves."""
    files = versions.current(spark, table)[1]
    modes = [(t, False, (None, "ci")[i % 2]) for i, t in enumerate(TERMS)] + [(t, True, None) for t in PATTERNS[::2]] + [(t, True, "ci") for t in PATTERNS[1::2]]
    base = table + "/data"
    rows = spark.read.schema(term_index.CASES).option("basePath", base).parquet(*[f"{base}/{f}" for f in files])
    found = rows.select(F.col("_metadata.file_path").alias("f"), *[search(t, pattern=p, collation=c).alias(f"m{i}") for i, (t, p, c) in enumerate(modes)]).collect()
    skipped = 0
    for i, (t, p, c) in enumerate(modes):
        left = set(term_index.files_with_term(spark, table, files, t, p, c))
        assert {versions.relative(r["f"]) for r in found if r[f"m{i}"]} <= left, (t, p, c)
        skipped += len(files) - len(left)
    assert skipped > 3 * len(modes)


@pytest.mark.parametrize("term, pattern, collation", [("PRINTER", False, "ci"), ("οδος", False, "ci"), ("cafe", False, "ai"), ("", False, None), ("d_sk", True, None)])
def test_search_equals_the_scan(spark, table, term, pattern, collation):
    f = CaseFilter(search=term, search_pattern=pattern, collation=collation)
    got = _ids(term_index.search_cases(spark, table, f))
    assert got and got == _ids(f.apply(scan_cases(spark, table)))


def test_trigrams_against_slices(spark):
    texts = ["abc", "AbCabc", "ab", "", None, "😀x😀y", "ΣΑΣ", "line\nbreak"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", term_index.trigrams(F.col("t")).alias("g")).collect()
    for r in got:
        low = (r.t or "").lower().replace("ς", "σ")
        assert sorted(r.g) == sorted({low[i:i + 3] for i in range(len(low) - 2)})


def test_files_without_the_term_are_not_read(spark, table):
    files = versions.current(spark, table)[1]
    left = term_index.files_with_term(spark, table, files, "needle")
    assert len(files) == len(TEXTS) and len(left) == 3  # the one that holds it, two that are not indexed
    f = CaseFilter(search="needle")
    assert sorted(versions.files_of(term_index.search_cases(spark, table, f))) == sorted(left)
    assert len(term_index.files_with_term(spark, table, files, "disk")) == 3  # in a folder whose name needs escaping
    for all_files in ("ne", "", "😀😀"):
        assert term_index.files_with_term(spark, table, files, all_files) == files
    assert term_index.files_with_term(spark, table, files, "_ee%dl_", pattern=True) == files
    assert term_index.files_with_term(spark, table, files, "needle", collation="ai") == files


def test_lookup_reads_the_index_by_a_pushed_filter(spark, table):
    wanted = term_index.term_grams(spark, "needle")
    assert sorted(wanted) == ["dle", "edl", "eed", "nee"]
    index = versions.read_or_none(spark, table + "/index/grams", term_index.GRAMS).filter(F.col("gram").isin(wanted))
    assert "PushedFilters: [In(gram" in index._jdf.queryExecution().toString()


def test_changed_files_and_a_run_that_stopped(spark, tmp_dir):
    path = tmp_dir + "/cases"
    log = dtab.cases_view(spark, SF001)
    append_cases(log, path)
    n = term_index.index_terms(spark, path)
    assert n == len(versions.current(spark, path)[1]) > 1
    word = log.filter("description is not null").orderBy("id").first().description[:12]
    f = CaseFilter(search=word)
    want = _ids(f.apply(log))
    assert want and _ids(term_index.search_cases(spark, path, f)) == want
    # grams without their list: as if the run had stopped, the files count as not indexed and are done again
    append_cases(log.withColumn("id", F.col("id") + 10**9), path)
    fresh = sorted(set(versions.current(spark, path)[1]) - term_index.indexed_files(spark, path))
    spark.createDataFrame([("zzz", fresh[0])], term_index.GRAMS).write.parquet(path + "/index/grams/part=stopped")
    assert _ids(term_index.search_cases(spark, path, f)) == sorted(want + [i + 10**9 for i in want])
    assert term_index.index_terms(spark, path) == len(fresh)
    assert _ids(term_index.search_cases(spark, path, f)) == sorted(want + [i + 10**9 for i in want])
    assert _ids(term_index.search_cases(spark, path, f, version=1)) == want
    assert _ids(api.search_stored(spark, path, None, CaseFilter(search=word, site="asia"))) == _ids(
        CaseFilter(search=word, site="asia").apply(scan_cases(spark, path)))


def test_plain_parts():
    assert plain_parts("a%b_c") == ["a", "b", "c"]
    assert plain_parts("100\\%x\\_y") == ["100%x_y"]
    assert plain_parts("a\\bc\\") == ["abc\\"]
    assert plain_parts("%_") == []


def test_empty_table(spark, tmp_dir):
    path = tmp_dir + "/cases"
    assert term_index.index_terms(spark, path) == 0
    assert term_index.search_cases(spark, path, CaseFilter(search="needle")).count() == 0
