"""Odd rows and clashing column names through the stages of the pipeline."""

import pytest

import corpus_pipeline

from .conftest import SF01

NAMES = ("score", "held_out", "predicted", "mix_size", "mix_times", "mix_taken", "kept_row", "secret_spans", "sp_encoded")


@pytest.fixture(scope="module")
def clashing(spark, odd_docs):
    from pyspark.sql import functions as F

    docs = odd_docs
    for c in NAMES:
        docs = docs.withColumn(c, F.lit("mine"))
    return docs


@pytest.mark.parametrize("at", range(4))
def test_a_stage_keeps_the_columns_it_got(spark, clashing, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, clashing, SF01)
    assert out.dtypes == clashing.dtypes, name
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in NAMES), name
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in clashing.collect()}
    assert stage(spark, clashing.limit(0), SF01).count() == 0


def test_near_dedup_and_mix_of_odd_rows(spark, clashing):
    kept = corpus_pipeline.near_dedup(spark, clashing, SF01).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(1) == 1 and 2 not in ids  # 2 repeats 1's text, twice
    assert any(r["text"] is None for r in kept) and any(r["text"] == "" for r in kept)  # texts without words stand alone
    mixed = corpus_pipeline.mix(spark, clashing, SF01).collect()
    assert all((r["text"] or "").strip() for r in mixed)  # size 0 is never taken


def test_tokens_of_odd_rows(spark, clashing):
    rows = corpus_pipeline.tokens(spark, clashing, SF01).collect()
    assert len(rows) == clashing.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {1}  # the end id alone
