"""The corpus pipeline: documents to training tokens in five stages.

quality classifier -> MinHash near-dedup -> secret scans -> source mix ->
SentencePiece.  Every stage is written as Parquet in the shared folder and
read again as the next one's ``docs``; a lost executor repeats its own tasks
only.

1. ``quality`` drops the documents that the classifier rejects (score below
   0.7), with labels from the table of the same folder.
2. ``near_dedup`` keeps one document (the smallest id) of each group of near
   copies.
3. ``secrets`` replaces every secret by a mark; n_chars follows the text.
4. ``mix`` repeats or leaves out documents so that sources come to their
   target weights; a document taken twice gives two rows.
5. ``tokens`` encodes the texts and decodes them again.

Stages hand on the columns that they got, under whatever names: what an
operator adds to its rows (``score``, ``mix_size``, ...) stands beside the row,
never in place of one of its columns.  Null and empty texts score as documents
without any n-gram (on the given labels they are rejected), have no copies, no
secrets and the size 0, so a mix takes none of them; a document without an id
is never labelled and never a near copy; repeated rows are one document after
the second stage; a null source is a source of its own; empty tables stay
empty.

The classifier cannot be written in SQL, so ``ORACLE_SQL`` is None and the
stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import dart_minhash, mixing, quality_nbsvm, secret_scan, sentencepiece_codec
from caseloom.llm.common import written
from caseloom.llm.queries import piece_model, table

ORACLE_SQL = None


def beside(docs: DataFrame, *used: str) -> DataFrame:
    """The rows as one column, next to the columns that an operator uses."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept_row"), *[docs[c] for c in used])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_nbsvm.score(beside(docs, "doc_id", "text"), labels).filter("predicted = 1").select("kept_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = docs.withColumn("text", secret_scan.redacted_column(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(beside(docs, "doc_id", "text", "source")).filter("mix_times > 0")
    return taken.select("kept_row", F.explode(F.array_repeat(F.lit(0), F.col("mix_times").cast("int"))).alias("copy")).select("kept_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(docs, piece_model(), decoded=False)
    return coded.select("doc_id", "lang", "source", "sp_encoded.n_tokens", "sp_encoded.ids_sha256", "sp_encoded.decoded_sha256", "sp_encoded.ids")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("secret scans", secrets), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return docs
