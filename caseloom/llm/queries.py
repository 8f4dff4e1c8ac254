"""The registered queries of the operators and of the pipeline, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import block_nn, chat_format, dart_minhash, dual_tree_search, embedding_dedup, fm_dedup, mixing, periodic_runs, quality_nbsvm, secret_scan, sentencepiece_codec, string_kernel_toxicity, wrapper_html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Where the public SentencePiece vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


@query
def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.expand(rows.unionByName(more)))
    return back.select(F.col("conv").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")


@query
def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_nbsvm.score(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return secret_scan.scan(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, shown), ",").alias("spans"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, piece_model(), ids=False, decoded=False).select("doc_id", "sp_encoded.n_tokens", "sp_encoded.ids_sha256", "sp_encoded.decoded_sha256")


@query
def op4_block_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return block_nn.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.dedup(rows, threshold=0.9)


@query
def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=35, full=False)


@query
def op7_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrapper_html.main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


@query
def op11_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return string_kernel_toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


@query
def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dual_tree_search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


ORACLE["op12_dual_tree_search"] = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM terms GROUP BY doc_id),
total AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS words FROM sizes),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY doc_id, term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // words)::BIGINT))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(periodic_runs.detect(docs, planted=True))


ORACLE["op1_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, '') AS id,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sized),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size, CASE WHEN level * w >= most THEN most
         ELSE least(most, max(CASE WHEN level * w < most THEN level END) OVER () * w) END AS target FROM filled),
wanted AS (
  SELECT d.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN least(2.0::DOUBLE, p.target / p.source_size) ELSE 0 END AS copies
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
ranked AS (
  SELECT *, floor(copies)::BIGINT AS sure, copies - floor(copies) AS p, floor(copies) + 1 <= 2 AND size > 0 AS open,
         CASE WHEN copies - floor(copies) > 0 THEN u / (1 - u) * (1 - (copies - floor(copies))) / (copies - floor(copies)) ELSE NULL END AS odds
  FROM wanted),
ordered AS (SELECT *, CASE WHEN p > 0 THEN odds / (1 + odds) * 0.999::DOUBLE ELSE 0.999::DOUBLE + 0.001::DOUBLE * u END AS rnk FROM ranked),
lefts AS (
  SELECT source, least(max(target) - sum(sure * size), sum(CASE WHEN open THEN size ELSE 0 END)) AS words_left FROM ordered GROUP BY source),
upto AS (
  SELECT o.*, l.words_left, sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY o.source ORDER BY open DESC, rnk, id, size) AS upto
  FROM ordered o JOIN lefts l ON o.source IS NOT DISTINCT FROM l.source),
gaps AS (
  SELECT source, max(words_left) - coalesce(max(CASE WHEN open AND upto <= words_left THEN upto END), 0) AS gap FROM upto GROUP BY source),
further AS (
  SELECT u.source, min(struct_pack(a := abs(u.size - g.gap), b := u.rnk, c := u.id, e := u.size)) AS x
  FROM upto u JOIN gaps g ON u.source IS NOT DISTINCT FROM g.source
  WHERE u.open AND u.upto > u.words_left AND abs(u.size - g.gap) < g.gap GROUP BY u.source)
SELECT u.doc_id, u.size, u.source_size, u.target,
       CASE WHEN u.size > 0 THEN (u.sure + CASE WHEN u.open AND (u.upto <= u.words_left
           OR (f.x IS NOT NULL AND u.rnk = f.x.b AND u.id = f.x.c AND u.size = f.x.e)) THEN 1 ELSE 0 END) * u.size ELSE 0 END::BIGINT AS taken
FROM upto u LEFT JOIN further f ON u.source IS NOT DISTINCT FROM f.source
"""

ORACLE["op2_chat_prefix_targets"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*(?:/?s>|</?SYS>>|\|role(?::[^|]*)?\|>|\|end\|>))', '<\\\1', 'g'),
                           '\[(\\*/?INST\])', '[\\\1', 'g') AS body,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
              ELSE length('<|role|><|end|>') + coalesce(1 + length(url_encode(role)), 0) END AS marks
  FROM rows_),
numbered AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(body) + marks) OVER o AS upto
  FROM escaped WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS n_examples
FROM numbered GROUP BY conv_id
"""

ORACLE["op5_fm_dedup"] = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT row, i, words[i] AS word, CASE WHEN i + 34 <= len(words) THEN array_to_string(words[i:i + 34], ' ') END AS run
  FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM texts)),
seen AS (SELECT *, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS again FROM starts),
covered AS (
  SELECT *, bool_or(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM seen)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, count(c.i) FILTER (WHERE gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM texts t LEFT JOIN covered c USING (row) GROUP BY t.row, t.doc_id, t.words
"""

ORACLE["op10_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
links AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.usable AND b.usable
    AND CASE WHEN a.usable AND b.usable THEN list_cosine_similarity(a.e, b.e) ELSE 0 END >= 0.9),
reach AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links,
       (SELECT min(b) FROM reach r WHERE r.a = v.vec_id)::BIGINT AS component_id,
       v.vec_id = (SELECT min(b) FROM reach r WHERE r.a = v.vec_id) AS kept
FROM v
"""
