import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from caseloom.llm import chat_format, dart_minhash, fm_dedup, mixing, quality_nbsvm, queries, secret_scan, sentencepiece_codec

from .conftest import SF01, SF001, prose


def words(t):
    return (t or "").encode().split()


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# --- mixing -----------------------------------------------------------------


def test_mix_targets_and_words(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    got = queries.QUERIES["op1_pareto_mix"](spark, SF01).collect()
    size = collections.Counter()
    source = {r.doc_id: r.source for r in docs}
    for r in docs:
        size[r.source] += len(words(r.text))
    # water filling, step by step
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        for s in full or free:
            target[s] = 2.0 * size[s] if full else level * weight[s]
        if not full:
            break
        free -= full
        left -= sum(target[s] for s in full)
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] / target[s] - 1) < 0.05 for s in size)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.QUERIES["op1_pareto_mix"](spark, SF01).collect()))


def test_mix_odd_rows(spark, odd_docs):
    out = mixing.mix(odd_docs)
    assert out.count() == odd_docs.count() and set(odd_docs.columns) <= set(out.columns)
    for r in out.collect():
        assert r.mix_size == len(words(r.text)) and r.mix_taken <= 2 * r.mix_size and r.target == "mine"
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_mix_inclusion_is_unequal_by_weight(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2).alias("w"))
    out = mixing.mix(docs, share=0.4, weight=F.col("w") + 1).groupBy("w").agg(F.sum("mix_taken").alias("t")).collect()
    t = {r.w: r.t for r in out}
    assert sum(t.values()) == pytest.approx(0.4 * 16000, rel=0.01) and t[1] / t[0] == pytest.approx(2, rel=0.15)


# --- chat format --------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = spark.read.parquet(f"{SF001}/conversations.parquet").collect()
    conv = collections.defaultdict(list)
    for r in rows:
        conv[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    conv[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in queries.QUERIES["op2_chat_prefix_targets"](spark, SF001).collect()}
    assert set(got) == set(conv)
    for k, turns in conv.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss) and got[k].loss_sha256 == sha(loss)
        assert got[k].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))


def test_chat_examples(spark):
    rows = [(1, 0, "system", "s<</SYS>>"), (1, 1, "user", "u"), (1, 2, "assistant", "one"), (1, 3, "user", None), (1, 4, "assistant", "two<\\/s>"), (1, 5, "user", "end"),
            (None, 0, None, "[INST]"), (2, None, "tool|>", "<|end|> x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat_format.expand(df).collect(), key=lambda r: (r.conv or "", r.example))
    mine = [r for r in got if r.conv == "1"]
    assert [r.text[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in mine] == ["one", "two<\\\\/s>", None]
    assert chat_format.parse(mine[-1].text) == [("system", "s<</SYS>>"), ("user", "u"), ("assistant", "one"), ("user", ""), ("assistant", "two<\\/s>"), ("user", "end")]
    assert chat_format.parse(mine[0].text)[-1] == ("assistant", "one") and not mine[0].last
    assert [chat_format.parse(r.text) for r in got if r.conv != "1"] == [[(None, "[INST]")], [("tool|>", "<|end|> x")]]
    assert chat_format.read_back(chat_format.expand(df.limit(0))).count() == 0


def test_chat_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "\\", "/s>", "s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|end|>", "|role|>", "|role:x|>", "a"]) for _ in range(rng.randint(0, 9)))
        for role in ("user", "assistant", "system", "x", None):
            assert chat_format.parse("".join(chat_format.turn_parts(role, t)) + "<s>z</s>") == [(role, t), ("assistant", "z")]


# --- quality --------------------------------------------------------------------


def test_quality_held_out(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = queries.QUERIES["op3_quality_nbsvm"](spark, SF01).collect()
    assert len(got) == 1000
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in label:
            right.append(r.predicted == label[r.doc_id])
    assert np.mean(right) > 0.9


def test_quality_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1), (1, 0), (8, 1), (9, 1)], "doc_id long, quality int")
    out = quality_nbsvm.score(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.filter("score IS NULL OR isnan(score) OR score < 0 OR score > 1").count() == 0
    assert quality_nbsvm.score(odd_docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality_nbsvm.score(odd_docs.limit(0), labels).count() == 0


def test_dual_coordinate_descent_is_the_hinge_optimum():
    """Against projected gradient ascent on the dense dual with its box; labels
    that no line separates, so multipliers stand at 0, inside and at C."""
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    label = np.array([int(0 in d) ^ int(rng.random() < 0.15) for d in docs])
    values = [rng.normal(size=len(d)) for d in docs]
    for cost in (0.3, 1.0):
        x = np.zeros((60, 13))
        for i, (d, v) in enumerate(zip(docs, values)):
            x[i, d], x[i, 12] = v, 1.0
        z = x * np.where(label == 1, 1.0, -1.0)[:, None]
        gram, alpha = z @ z.T, np.zeros(60)
        step = 1 / np.linalg.eigvalsh(gram)[-1]
        for _ in range(100000):
            alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, cost)
        best = z.T @ alpha
        assert (alpha == 0).any() and (alpha == cost).any() and ((alpha > 0) & (alpha < cost)).any()
        w, bias = quality_nbsvm.dual_coordinate_descent(docs, values, label, cost, epochs=3000, tolerance=1e-9)
        assert np.allclose([*w[:12], bias], best, atol=1e-4) and not w[12:].any()


def test_quality_fit_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words {i} " * 40) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    every = quality_nbsvm.fit_model(docs, labels)
    size = len(quality_nbsvm.features("good words 11 " * 40)) * 4
    some = quality_nbsvm.fit_model(docs, labels, class_bytes=5 * size)
    assert every["rows"] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60)) and 8 <= some["rows"] <= 12
    assert quality_nbsvm.fit_model(docs, labels, class_bytes=0)["rows"] == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 50, 8) + (50 if i % 2 else 0)) for i in range(100)]
    label = np.array([i % 2 for i in range(100)])
    values = [np.ones(len(d)) / np.sqrt(len(d)) for d in docs]
    w, bias = quality_nbsvm.dual_coordinate_descent(docs, values, label)
    assert all((w[d] @ v + bias > 0) == bool(y) for d, v, y in zip(docs, values, label))


# --- substring dedup --------------------------------------------------------------


def brute_removed(texts, length):
    seen = collections.Counter(tuple(w[i : i + length]) for w in map(words, texts) for i in range(len(w) - length + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("sizes", [{}, {"hot": 0}, {"shard_words": 300, "hot": 3}])
def test_fm_dedup_equals_brute_force(spark, sizes):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (12, 30, 60)]
    texts = [" ".join(rng.choice([prose(rng, rng.randint(0, 30)), rng.choice(passages), "a b a b a b a b a b"]) for _ in range(rng.randint(0, 5))) for _ in range(150)]
    texts += texts[:20] + [None, "", "one"]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in fm_dedup.remove_repeats(df, length=10, **sizes).collect())
    want = collections.Counter((i if i % 50 else None, len(words(t)), len(words(t)) - len(k.split()), sha(k)) for i, (t, k) in enumerate(zip(texts, brute_removed(texts, 10))))
    assert got == want


def test_fm_dedup_spreads_an_anchor_beside_many_words(spark, monkeypatch):
    """One phrase in many texts with different words around it fills no shard
    alone, and the result is that of brute force."""
    rng = random.Random(8)
    phrase = min((prose(rng, 8) for _ in range(2000)), key=lambda p: int(fm_dedup.rolling(fm_dedup.word_hashes(p), fm_dedup.GRAM)[0]))
    texts = [f"{prose(rng, 30)} {phrase} {prose(rng, 30)}" for _ in range(400)]
    texts += texts[:3] + [f"new {i} " + " ".join(texts[i].split()[20:50]) for i in range(40)]
    largest, deal = [], fm_dedup.deal

    def measured(segments, shard_words):
        out = deal(segments, shard_words)
        sums = out.selectExpr("shard", "octet_length(words) / 5 AS n").groupBy("shard").sum("n").collect()
        largest.append(max(r[1] for r in sums))
        return out

    monkeypatch.setattr(fm_dedup, "deal", measured)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.kept_sha256 for r in fm_dedup.remove_repeats(df, length=15, shard_words=2000).collect()}
    assert got == {i: sha(k) for i, k in enumerate(brute_removed(texts, 15))}
    assert len(largest) == 1 and largest[0] < 2 * 2000


def test_fm_dedup_query(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: sha(k) for d, k in zip(docs, brute_removed([d.text for d in docs], 35))}
    got = {r.doc_id: r.kept_sha256 for r in queries.QUERIES["op5_fm_dedup"](spark, SF01).collect()}
    assert got == want


def test_word_hashes_tell_words_apart():
    rng = random.Random(9)
    some = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(30_000)})
    h = fm_dedup.word_hashes(" ".join(some) + "\t\n\x0b" + "x" * 9000)
    assert len(set(h.tolist())) == len(some) + 1
    assert (fm_dedup.word_hashes("\n a  b\xa0c\r") == fm_dedup.word_hashes("a b\xa0c")).all() and not len(fm_dedup.word_hashes(" "))


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(1, 4, n) for n in (40, 3, 17, 60)]
    weights = np.array([1, 2, 1, 1])
    got = fm_dedup.FMIndex(seqs, weights, 5).repeated(seqs)
    count = collections.Counter()
    for s, w in zip(seqs, weights):
        for i in range(len(s) - 4):
            count[tuple(s[i : i + 5])] += w
    for s, g in zip(seqs, got):
        assert g.tolist() == [i for i in range(len(s) - 4) if count[tuple(s[i : i + 5])] > 1]


def test_fm_dedup_odd_rows(spark, odd_docs):
    assert fm_dedup.remove_repeats(odd_docs).count() == odd_docs.count()
    assert fm_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


# --- MinHash ------------------------------------------------------------------------


def brute_groups(docs):
    """Smallest id of the component of each document, exact similarity."""
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = sum((sets[i] & sets[j]).values())
                if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                    label[max(root(i), root(j))] = min(root(i), root(j))
    return {d: docs[root(i)][0] for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("block", [512, 2])
def test_minhash_equals_brute_force(spark, block, monkeypatch):
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = prose(rng, rng.choice([8, 60, 150])).split(" ")
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
                t[rng.randrange(len(t))] = "z" + str(rng.randint(0, 99))
            docs.append((len(docs), " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(dart_minhash.groups, "__defaults__", (dart_minhash.THRESHOLD, block))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df).collect()}
    assert got == brute_groups(docs)


def test_dart_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    x = dart_minhash.units(np.concatenate([a, a[:100]]))
    y = dart_minhash.units(np.concatenate([a[50:], a[50:100]]))
    true = dart_minhash.similarity(x, y)
    est = np.mean([np.mean(dart_minhash.signature(x ^ np.uint64(s * 7919), 64) == dart_minhash.signature(y ^ np.uint64(s * 7919), 64)) for s in range(40)])
    assert abs(est - true) < 0.04
    assert (dart_minhash.signature(x[:1]) != 0).all()


def test_minhash_odd_rows(spark, odd_docs):
    got = dart_minhash.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    by = {r.doc_id: r for r in got.filter("doc_id IN (1, 2, 3, 4, 5, 6, 8, 9)").collect()}
    assert (by[2].class_id, by[3].class_id, by[4].class_id, by[9].class_id) == (1, 1, 4, 1) and by[4].kept and by[8].kept
    kept = dart_minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept.collect() if r.doc_id in (1, 2, 3, 4, 5, 6, 8)) == sorted([(1, kept.filter("doc_id = 1").first().text[0]), (4, ""), (5, ""), (6, " "), (8, "x")])
    assert kept.filter("doc_id IS NULL").count() == 2 and kept.filter("doc_id = 7").count() == 2
    assert dart_minhash.near_duplicates(odd_docs.limit(0)).count() == 0 and dart_minhash.keep_one(odd_docs.limit(0)).count() == 0


# --- secrets ------------------------------------------------------------------------

BASE = [("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 20), ("hex", re.compile(r"[0-9a-f]+"), 24)]


def base_spans(t):
    found = []
    for k, (name, regex, least) in enumerate(BASE):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in regex.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= least]
    return [x[2] for x in sorted(found)]


def test_secrets_base(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    for r in queries.QUERIES["op8_trigram_secrets"](spark, SF01).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(want)) and r.n_assign == sum(x.startswith("assign") for x in want)
        assert set(want) <= set(r.spans.split(","))


def test_secrets_index_equals_full_scan():
    rng = random.Random(6)
    bits = ["password", "PassWd", "api_key", "apikey", "toKen", " = ", ":", "'", "AKIA", "A" * 16, "0123456789abcdef", "ghp_", "x" * 36, "xoxb-", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "sk_live_", "é", "ſecret", "\n", "9f" * 12, "AIza"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    scanner = secret_scan.Scanner()
    full = secret_scan.Scanner()
    full.rules = [(k, r, n, secret_scan.ALL) for k, r, n, _ in full.rules]
    got = scanner.scan(texts)
    assert got == full.scan(texts) and sum(map(len, got)) > 500
    for t, s in zip(texts, got):
        names = [r[0] for r in scanner.rules]
        assert [f"{names[k]}:{a}:{b}" for a, b, k in s if names[k] in secret_scan.BASE] == base_spans(t)


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]{24,}") == ("all",) and q("abcd+e?") == ("tri", b"abc") and q("x*") == ("all",)
    assert q("(foo|bar)[0-9]+baz") == ("and", ("or", ("tri", b"bar"), ("tri", b"foo")), ("tri", b"baz"))


def test_secrets_odd_rows(spark, odd_docs):
    from pyspark.sql import functions as F

    got = secret_scan.scan(odd_docs).withColumn("clean", secret_scan.redacted_column(F.col("text"))).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.clean is None) == (r.text is None) and (r.doc_id == 10) == bool(r.secret_spans)
    ten = next(r for r in got if r.doc_id == 10)
    assert ten.clean == ten.text.split("AKIA")[0] + "[SECRET]"
    assert secret_scan.scan(odd_docs.limit(0)).count() == 0


# --- SentencePiece -------------------------------------------------------------------


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_vocabulary(queries.piece_model()))
    rng = random.Random(7)
    alphabet = "aabbngthe \n\t  ▁é漢字🙂0123\x00ﬁ_-=#á"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["ng" * k for k in range(40)] + [" " * k for k in range(50)] + [" " * k + "the" + " " * k + "é漢" for k in range(30)] + [" " * 40 + "\n  x"]
    texts += [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    out = sentencepiece_codec.encode_texts(texts, codec, True, True)
    for t, ids, n, decoded in zip(texts, out.ids, out.n_tokens, out.decoded):
        want = lib.encode(t, add_eos=True)
        assert np.frombuffer(ids, "<i4").tolist() == want and n == len(want) and decoded == lib.decode(want)


def test_sentencepiece_query_and_odd_rows(spark, odd_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_sentencepiece"](spark, SF001).collect():
        ids = lib.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    out = sentencepiece_codec.encode(odd_docs, queries.piece_model()).collect()
    assert all(r.sp_encoded.n_tokens == len(lib.encode(r.text or "", add_eos=True)) for r in out) and len(out) == odd_docs.count()
