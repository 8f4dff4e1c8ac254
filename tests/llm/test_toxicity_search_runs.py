"""Toxicity, ranked search and periodic runs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import dual_tree_search as D
from caseloom.llm import periodic_runs as P
from caseloom.llm import queries
from caseloom.llm import string_kernel_toxicity as S

from .conftest import SF01, prose


# --- periodic runs -----------------------------------------------------------

def every_run(words, least=6, power=4):
    """All runs by trying every period."""
    n, best = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(least, power * q):
                best.setdefault((a, i + q - a), q)
    return sorted((a, length, q) for (a, length), q in best.items())


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        n, letters, s = rng.randint(0, 70), rng.randint(1, 4), []
        while len(s) < n:
            s += [rng.randrange(letters) for _ in range(rng.randint(1, 7))] * rng.choice([1, 1, 2, 4, 5, 6])
        words = [b"w%d" % x for x in s]
        want = every_run(words)
        assert P.find_runs(s) == want
        assert P.batch_runs([words[: n // 2], words, []]) == [every_run(words[: n // 2]), want, []]


def test_runs_of_deep_paths():
    # one word alone, Fibonacci and Thue-Morse words: deep and branching link trees
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    for text in ("a" * 20_000, b, morse, "ab" * 500 + "c" + "ab" * 500):
        words = [x.encode() for x in text]
        assert P.batch_runs([words])[0] == (every_run(words) if len(set(words)) > 1 else [(0, len(words), 1)])


def test_kept_words():
    assert P.kept_words(10, [(2, 8, 2)]).tolist() == [True] * 4 + [False] * 6
    assert P.kept_words(0, []).tolist() == []


def test_runs_query_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF01).collect()}
    assert rows.keys() == docs.keys()
    import hashlib

    seen = 0
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if x < a else words[a + (x - a) % p] for x, w in enumerate(words)]
        if n > 1500:
            continue  # trying every period is quadratic; the rest is compared
        runs, r = every_run(words), rows[i]
        seen += len(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        drop = {x for a, b, c in runs for x in range(a + c, a + b)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for x, w in enumerate(words) if x not in drop).encode()).hexdigest()
    assert seen > 100


def test_runs_of_odd_rows(spark, odd_docs):
    got = P.detect(odd_docs, planted=True)
    assert got.columns == odd_docs.columns + ["run_words", "run_list", "run_collapsed"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and {r["target"] for r in rows} == {"mine"}
    for r in rows:
        if not (r["text"] or "").strip():
            assert (r["run_words"], r["run_list"], r["run_collapsed"]) == (0, [], "")
    assert P.digest(P.detect(odd_docs.limit(0))).count() == 0


# --- ranked search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best_documents(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_terms_of_bytes_are_those_of_code_points():
    text = "The İ-Straße 3x, naïve_co-op `q` {z} É\x00\x7fÀ B 🙂"
    assert [t.decode() for t in D.terms(text)] == terms(text)


def test_search_equals_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("ABCDEFGH") + str(min(int(rng.expovariate(0.15)), 40)) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (1000, docs[9][1]), (1001, docs[9][1]), (1002, None), (1003, "?? !")]
    items = [(j, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 45)) for _ in range(rng.randint(1, 25)))) for j in range(60)]
    items += [(100, None), (101, "..."), (102, "nowhere"), (103, docs[9][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    want = best_documents(docs, items, 4)
    for block in ((1024, 8192), (7, 8192), (50, 100)):
        got = D.search(frame, wanted, k=4, block_items=block[0], block_terms=block[1], seed_share=0.3)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_pruning_drops_pairs_but_no_result():
    rng = np.random.default_rng(2)
    weights = np.zeros((80, 200))
    for r in range(80):
        weights[r, rng.integers(r // 20 * 50, r // 20 * 50 + 50, 8)] = rng.integers(1, 100, 8)
    impact = np.zeros((2000, 200))
    for r in range(2000):
        impact[r, rng.integers(r % 4 * 50, r % 4 * 50 + 50, 5)] = rng.integers(1, 1000, 5)
    items = D.Items(weights, 3, np.zeros(80))
    items.search(list(range(2000)), impact)
    exact = weights @ impact.T
    assert items.scored < exact.size / 2
    got = {}
    for item, doc, score in items.rows():
        got.setdefault(item, []).append((-score, doc))
    for item in range(80):
        order = sorted((-int(s), i) for i, s in enumerate(exact[item]) if s > 0)[:3]
        assert sorted(got.get(item, [])) == order


def test_search_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "x AKIA letter"), (1, "rain"), (None, "x"), (2, None)], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in D.search(odd_docs, items, k=50).collect()), key=str)
    assert got == sorted(best_documents(docs, [(1, "x AKIA letter rain")], 50) + best_documents(docs, [(None, "x")], 50), key=str)
    assert D.search(odd_docs.limit(0), items).count() == 0
    assert D.search(odd_docs, items.limit(0)).count() == 0


# --- toxicity ----------------------------------------------------------------

def plain_kernel(a, b, decay=S.DECAY, order=S.ORDER):
    """All common subsequences, spelled out."""
    from itertools import combinations

    def weights(s):
        out = Counter()
        for at in combinations([i for i, c in enumerate(s) if c != "\0"], order):
            out["".join(s[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y[k] for k, v in x.items())


def test_kernel_equals_enumeration():
    rng = random.Random(5)
    a = ["".join(rng.choice("^abc\0") for _ in range(rng.randint(1, S.WIDTH))) for _ in range(200)]
    b = ["".join(rng.choice("^abc\0") for _ in range(rng.randint(1, S.WIDTH))) for _ in range(200)]
    got = S.kernel(S.codes(a), S.codes(b))
    assert np.allclose(got, [plain_kernel(x.rstrip("\0"), y.rstrip("\0")) for x, y in zip(a, b)], rtol=1e-4)


def test_bound_loses_no_similarity():
    rng = random.Random(6)
    marks = S.Landmarks(["^idiot", "^moron", "^lowei", "^chón"])
    words = ["".join(rng.choice("idotmrnlwechó") for _ in range(rng.randint(2, 14))) for _ in range(3000)] + ["idiot", "i-d-i-o-t", "id1ot", "moronic"]
    near = marks.similar(words)
    for w in set(words):
        want = np.zeros(4)
        for u in S.windows(w):
            c = np.repeat(S.codes([u]), 4, axis=0)
            v = S.kernel(c, marks.code) / np.sqrt(np.maximum(S.kernel(c, c) * marks.norm, 1e-12))
            want = np.maximum(want, np.where(v >= S.NEAR, v, 0))
        assert np.allclose(near.get(w, np.zeros(4)), want, atol=1e-5)


def test_dual_is_optimal():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 4)) + 0.7, rng.normal(size=(60, 4)) - 0.7])
    x = np.concatenate([x, np.ones((120, 1))], axis=1)
    y, cost = np.repeat([1.0, -1.0], 60), np.full(120, 0.5)
    primal = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = S.dual_coordinate_descent(x, y, cost, epochs=400)
    assert all(primal(w) <= primal(w + rng.normal(size=5) * s) + 1e-3 for s in (0.3, 0.1, 0.03) for _ in range(50))


@pytest.fixture(scope="module")
def insulted(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(500):
        toxic = i % 3 == 0
        words = prose(rng, rng.randint(30, 200)).split(" ")
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "grumbo" + rng.choice(["la", "ster", "ix"])]))
        docs.append((i, ". ".join(" ".join(words[x : x + 9]) for x in range(0, len(words), 9))))
        labels.append((i, int(toxic)))
    more = ["you b.l.o.c.k.h.e.a.d and n i t w i t here", "a nit-wit, a blockxhead, a nitwiit", "quiet rain over the table", "", None]
    docs += [(1000 + x, t) for x, t in enumerate(more)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(7, None), (8, 5), (None, 1), (0, 0)], "doc_id long, toxic int")


def test_toxicity_held_out_and_disguised(insulted):
    docs, labels = insulted
    rows = {r["doc_id"]: r for r in S.score(docs, labels).collect()}
    for i in range(1, 500):
        assert rows[i]["predicted"] == int(i % 3 == 0), rows[i]
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [rows[1000 + x]["predicted"] for x in range(5)] == [1, 1, 0, 0, 0]
    assert rows[1003]["score"] == rows[1004]["score"]


def test_toxicity_ignores_held_out_labels(insulted):
    docs, labels = insulted
    other = labels.withColumn("toxic", S.F.when(S.held_out(S.F.col("doc_id")), 1 - S.F.col("toxic")).otherwise(S.F.col("toxic")))
    assert S.fit_model(docs, labels) == S.fit_model(docs, other)


def test_toxicity_of_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    both = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (8, 1)], "doc_id long, toxic int")
    for labels in (none, one, both):
        rows = S.score(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["target"] == "mine" for r in rows)
    assert {r["score"] for r in S.score(odd_docs, none).collect()} == {0.5}
    assert S.score(odd_docs.limit(0), both).count() == 0


def test_toxicity_planted_words(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.QUERIES["op11_string_kernel_toxicity"](spark, "/root/testdata/sf0.1").collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    clean = [1 - r["predicted"] for r in held if labels[r["doc_id"]] == 0]
    assert len(caught) > 50 and np.mean(caught) > 0.8 and np.mean(clean) > 0.95
