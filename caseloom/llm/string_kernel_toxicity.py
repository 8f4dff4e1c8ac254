"""Toxicity: a subsequence string-kernel support vector machine with Nyström
landmarks.

A word, lower-cased and with a mark before its start, is seen in windows of
``WIDTH`` symbols; what is not a letter takes up a place but matches nothing.
Two windows are compared by the gap-weighted subsequence kernel of three
letters (a common subsequence counts ``DECAY`` for every place that it spans in
either), normalised to 1 for equals.  Inserted marks or letters, dropped
letters and endings lower it gradually, so disguised insults stay near their
plain form.  Runs of words of one letter are also read as one word.

Landmarks are word beginnings, chosen by greedy weighted cover: each next one
stands in most toxic training documents that few landmarks cover so far, and
seldom in clean ones.  A word's vector is ``K^(-1/2) k(word, landmarks)``, with
similarities below ``NEAR`` taken as 0.

Training is on sentences: those of clean documents are labelled 0, those of
toxic documents 1 where their best word is near a landmark or, from the second
round on, on the positive side; a sentence stands for its best word.  The
hinge-loss SVM is solved by dual coordinate descent.  A document's score is a
logistic function of its greatest sentence value, the number of positive
sentences and their number a word, fitted on documents that the SVM of another
fold scored, weighted to the labels' own class frequencies.

The kernel of a pair is computed only where an upper bound reaches ``NEAR``: by
Cauchy-Schwarz the similarity is at most the share of the landmark's norm on
subsequences that use the word's letters alone, a table of each landmark by
set of letters.  The bound loses nothing.

The model is fitted in one task on a bounded sample: at most ``PER_CLASS``
labelled documents a class, first by a hash of the id, and at most
``CLASS_BYTES`` of text a class (whole texts; one that does not fit is left
out).  Scoring reads every whole text in place, without a shuffle.

Handled: null and empty texts (the score of a document without any match),
null or other labels (dropped; the least label of an id counts), one class
only (every score is the share of label 1; 0.5 without labels), no landmark
(the same), null ids (never labelled), repeated rows, long texts, empty
tables.  Document columns named held_out, score or predicted are replaced;
the others stay.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import small_batches, written

WIDTH, STRIDE, DECAY, ORDER = 12, 4, 0.6, 3
NEAR = 0.55
LANDMARKS = 160
PER_CLASS, CLASS_BYTES = 2500, 12_000_000
#: Words whose values a worker keeps.
KEPT_WORDS = 400_000

GAP = re.compile(r"[\W\d_]")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
MODEL = "landmarks array<string>, beta array<double>, bias double, logit array<double>, rows long"


def windows(word: str) -> list[str]:
    """The windows of a word; a gap is a zero character."""
    s = "^" + (word if word.isalpha() else GAP.sub("\0", word).strip("\0"))
    if len(s) <= WIDTH:
        return [s] if len(s) > ORDER else []
    at = list(range(0, len(s) - WIDTH, STRIDE)) + [len(s) - WIDTH]
    return [s[i : i + WIDTH] for i in at]


def codes(units: list[str]) -> np.ndarray:
    """Letters as numbers, one row a window, 0 for gaps and behind the end."""
    if not units:
        return np.zeros((0, WIDTH), dtype=np.uint32)
    return np.array([u.ljust(WIDTH, "\0") for u in units], dtype=f"<U{WIDTH}").view("<u4").reshape(len(units), WIDTH)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The gap-weighted subsequence kernel of each pair of rows."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), 8192):
        # pairs along the last axis
        s, t = np.ascontiguousarray(a[lo : lo + 8192].T), np.ascontiguousarray(b[lo : lo + 8192].T)
        t = t[: int(np.flatnonzero(t.any(axis=1)).max(initial=0)) + 1]
        same = ((s[:, None] == t[None, :]) & (s != 0)[:, None]) * np.float32(DECAY**2)
        ends = same
        for _ in range(ORDER - 1):
            # sums over earlier ends in both, decayed by the places between
            sums = ends.copy()
            for i in range(1, len(s)):
                sums[i] += DECAY * sums[i - 1]
            for j in range(1, len(t)):
                sums[:, j] += DECAY * sums[:, j - 1]
            ends = np.zeros_like(same)
            np.multiply(same[1:, 1:], sums[:-1, :-1], out=ends[1:, 1:])
        out[lo : lo + 8192] = ends.sum(axis=(0, 1))
    return out


class Landmarks:
    """Similarities of words to a list of landmarks."""

    def __init__(self, names: list[str]):
        self.names, self.code = names, codes(names)
        self.norm = kernel(self.code, self.code)
        letters = sorted({int(c) for c in self.code.ravel()} - {0})
        self.letter = {c: i for i, c in enumerate(letters)}
        self.power = np.zeros((len(letters), len(names)), dtype=np.float32)
        self.bound = np.zeros((len(names), 1 << WIDTH), dtype=np.float32)
        for j, row in enumerate(self.code):
            own = sorted({int(c) for c in row} - {0})
            for bit, c in enumerate(own):
                self.power[self.letter[c], j] = 1 << bit
            masks = np.arange(1 << len(own))
            place = np.array([own.index(int(c)) if c else -1 for c in row])
            held = np.where((place >= 0) & ((masks[:, None] >> np.maximum(place, 0)) & 1 == 1), row, 0).astype(np.uint32)
            self.bound[j, : len(masks)] = np.sqrt(kernel(held, held) / self.norm[j])

    def similar(self, words: list[str]) -> dict[str, np.ndarray]:
        """The vector of similarities, its least ``NEAR``, of every word that
        is near a landmark."""
        out: dict[str, np.ndarray] = {}
        if not self.names:
            return out
        units = [(u, w) for w in words for u in windows(w)]
        for lo in range(0, len(units), 20_000):
            part = units[lo : lo + 20_000]
            code = codes([u for u, _ in part])
            holds = np.zeros((len(part), len(self.letter)), dtype=np.float32)
            known = np.array(sorted(self.letter), dtype=np.uint32)
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            r, c = np.nonzero(known[at] == code)
            holds[r, at[r, c]] = 1
            mask = (holds @ self.power).astype(np.int64)
            row, mark = np.nonzero(self.bound[np.arange(len(self.names))[None, :], mask] >= NEAR)
            if not len(row):
                continue
            some, back = np.unique(row, return_inverse=True)
            own = kernel(code[some], code[some])[back]
            value = kernel(code[row], self.code[mark]) / np.sqrt(np.maximum(own * self.norm[mark], 1e-12))
            for i in np.flatnonzero(value >= NEAR).tolist():
                word = part[int(row[i])][1]
                vector = out.setdefault(word, np.zeros(len(self.names), dtype=np.float32))
                vector[mark[i]] = max(vector[mark[i]], value[i])
        return out


def spelled(words: list[str], letters: set[str]) -> list[str]:
    """Runs of three or more one-letter words (``letters``), as one word each."""
    at = [i for i, w in enumerate(words) if w in letters]
    if not any(y - x == ORDER - 1 for x, y in zip(at, at[ORDER - 1 :])):
        return []
    out, run = [], []
    for i in [*at, len(words) + 1]:
        if run and i != run[-1] + 1:
            if len(run) >= ORDER:
                out.append(" ".join(words[x][0] for x in run))
            run = []
        run.append(i)
    return out


class Text:
    """A document's words and, on demand, its sentences."""

    def __init__(self, text: str | None):
        self.text = ("" if text is None else text).lower()
        listed = self.text.split()
        self.n = len(listed)
        self.words = set(listed)
        letters = {w for w in self.words if len(w) < 3 and w[0].isalpha() and not w[1:].isalpha()}
        self.runs = spelled(listed, letters) if len(letters) > 1 else []
        self.words.update(self.runs)

    def sentences(self, wanted) -> list[list[str]]:
        """The wanted words of each sentence that has any."""
        found = [[w for w in set(s.split()) if w in wanted] for s in SENTENCE.split(self.text)]
        return [s for s in found if s] + [[w] for w in self.runs if w in wanted]


def beginnings(words) -> set[str]:
    """The candidates for landmarks in a document."""
    out = set()
    for w in words:
        first = windows(w)
        if first and "\0" not in first[0] and first[0][0] == "^":
            s = first[0]
            out.add(s)
            out.update(s[:k] for k in range(5, min(len(s), 10)))
    return out


def choose(docs: list[Text], label: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Greedy weighted cover of the toxic documents by word beginnings."""
    held = [beginnings(d.words) for d in docs]
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    where: dict[str, list[int]] = {}
    count = Counter(u for h, y in zip(held, label) if y for u in h)
    least = max(3, n1 // 400)
    where = {u: [] for u, c in count.items() if c >= least}
    clean = Counter(u for h, y in zip(held, label) if not y for u in h if u in where)
    where = {u: [] for u in where if count[u] / n1 >= 6 * (clean[u] + 0.5) / n0}
    for i, (h, y) in enumerate(zip(held, label)):
        if y:
            for u in h:
                if u in where:
                    where[u].append(i)
    need = np.ones(len(docs))
    places = {u: np.array(x) for u, x in where.items()}
    # gains only fall, so the greatest is looked at again until it stays the greatest; the longer of equals is the more exact
    queue = [(-float(len(x)), -len(u), u) for u, x in places.items()]
    heapq.heapify(queue)
    chosen: list[str] = []
    while queue and len(chosen) < most:
        gain, size, best = heapq.heappop(queue)
        now = float(need[places[best]].sum()) - clean[best] * n1 / n0
        if now < least * 0.5:
            continue
        if now < -gain - 1e-9:
            heapq.heappush(queue, (-now, size, best))
            continue
        chosen.append(best)
        need[places[best]] *= 0.5
    return chosen


def dual_coordinate_descent(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 40, seed: int = 11) -> np.ndarray:
    """Hinge loss: min |w|^2/2 + sum C_i max(0, 1 - y_i w.x_i); the last column is the bias."""
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(x)).tolist():
            g = y[i] * (w @ x[i]) - 1.0
            old = alpha[i]
            pg = min(g, 0.0) if old <= 0 else max(g, 0.0) if old >= cost[i] else g
            if pg:
                alpha[i] = min(max(old - g / q[i], 0.0), cost[i])
                w += (alpha[i] - old) * y[i] * x[i]
                worst = max(worst, abs(pg))
        if worst < 1e-3:
            break
    return w


def train(docs: list[Text], label: np.ndarray, rounds: int = 3):
    """Landmarks, their coefficients and the bias; None without landmarks."""
    names = choose(docs, label)
    if not names:
        return None
    marks = Landmarks(names)
    near = marks.similar(sorted(set().union(*[d.words for d in docs])))
    m = len(names)
    gram = np.array([kernel(np.repeat(marks.code[j : j + 1], m, axis=0), marks.code) for j in range(m)]) / np.sqrt(np.outer(marks.norm, marks.norm))
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    words = sorted(near)
    number = {w: i for i, w in enumerate(words)}
    raw = np.array([near[w] for w in words]).reshape(len(words), m).astype(np.float64)
    x = np.concatenate([raw @ root, np.ones((len(words), 1))], axis=1)
    sentences = [(y, [number[w] for w in s]) for d, y in zip(docs, label) for s in d.sentences(near)]
    low = np.zeros(len(words))
    for y, s in sentences:
        if y == 0:
            low[s] += 1
    value, w = raw.max(axis=1) - 0.8, None
    for _ in range(rounds):
        high = np.zeros(len(words))
        for y, s in sentences:
            if y == 1:
                best = max(s, key=lambda i: value[i])
                if value[best] >= 0:
                    high[best] += 1
        rows = np.concatenate([np.flatnonzero(high), np.flatnonzero(low)])
        y = np.concatenate([np.ones(int((high > 0).sum())), -np.ones(int((low > 0).sum()))])
        if len(set(y.tolist())) < 2:
            # no clean sentence is near a landmark: a sentence without any word near one stands for them
            rows, y = np.append(rows, 0), np.append(y, -1.0)
            points = x[rows].copy()
            points[-1, :-1] = 0
        else:
            points = x[rows]
        cost = 2.0 * np.minimum(np.concatenate([high[high > 0], low[low > 0], np.ones(len(rows) - int((high > 0).sum()) - int((low > 0).sum()))]), 20.0)
        # an empty sentence is clean
        points = np.concatenate([points, np.zeros((1, m + 1))])
        points[-1, -1] = 1
        w = dual_coordinate_descent(points, np.append(y, -1.0), np.append(cost, 200.0))
        value = x @ w
    return names, root @ w[:-1], float(w[-1])


class Scorer:
    """Values of words, sentences and documents under a trained model."""

    def __init__(self, names: list[str], beta: np.ndarray, bias: float):
        self.marks, self.beta, self.bias = Landmarks(names), np.asarray(beta, dtype=np.float64), bias
        self.known: dict[str, float | None] = {}

    def learn(self, docs: list[Text]) -> None:
        new = set().union(*[d.words for d in docs]) - self.known.keys() if docs else set()
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = set().union(*[d.words for d in docs])
        self.known.update(dict.fromkeys(new))
        for w, v in self.marks.similar(sorted(new)).items():
            self.known[w] = float(v @ self.beta) + self.bias

    def features(self, doc: Text) -> np.ndarray:
        """Greatest sentence value, positive sentences, and those a word."""
        hot = {w: v for w in doc.words if (v := self.known.get(w)) is not None}
        top, many = self.bias, 0
        if hot:
            for s in doc.sentences(hot):
                value = max(hot[w] for w in s)
                top, many = max(top, value), many + (value > 0)
        return np.array([1.0, min(max(top, -2.0), 2.0), np.log1p(many), np.log1p(1000.0 * many / max(doc.n, 1))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps on the weighted log loss with a ridge."""
    b, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * b)
        b = b - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(texts: list[str], label: np.ndarray, share_of_1: float, folds: int = 2) -> dict:
    docs = [Text(t) for t in texts]
    p = min(max(share_of_1 if len(label) else 0.5, 1e-6), 1 - 1e-6)
    flat = {"landmarks": [], "beta": [], "bias": 0.0, "logit": [float(np.log(p / (1 - p))), 0.0, 0.0, 0.0], "rows": len(docs)}
    if len(set(label.tolist())) < 2:
        return flat
    model = train(docs, label)
    if model is None:
        return flat
    fold = np.zeros(len(docs), dtype=int)
    for y in (0, 1):
        fold[label == y] = np.arange(int((label == y).sum())) % folds
    x, known = np.zeros((len(docs), 4)), np.zeros(len(docs), dtype=bool)
    for f in range(folds):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        part = train([docs[i] for i in rest], label[rest]) if len(set(label[rest].tolist())) == 2 else None
        if part is None:
            continue
        scorer = Scorer(*part)
        for lo in range(0, len(own), 500):
            mine = [docs[i] for i in own[lo : lo + 500]]
            scorer.learn(mine)
            x[own[lo : lo + 500]] = [scorer.features(d) for d in mine]
        known[own] = True
    if len(set(label[known].tolist())) < 2:
        scorer = Scorer(*model)
        scorer.learn(docs)
        x, known = np.array([scorer.features(d) for d in docs]), np.ones(len(docs), dtype=bool)
    weight = np.where(label == 1, p / (label == 1).mean(), (1 - p) / (label == 0).mean())
    b = logistic(x[known], label[known].astype(float), weight[known])
    return {"landmarks": model[0], "beta": model[1].tolist(), "bias": model[2], "logit": b.tolist(), "rows": len(docs)}


def _fit_task(per_class_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, label, share, used = [], [], 0.5, {0: 0, 1: 0}
        for f in frames:  # in the order of the hash of the id
            for t, y, share in zip(f["text"].tolist(), f["y"].tolist(), f["share"].tolist()):
                size = len(t.encode("utf-8", "replace")) if t else 0
                if used[y] + size <= per_class_bytes:
                    used[y] += size
                    texts.append(t)
                    label.append(y)
        made = fit(texts, np.array(label, dtype=int), share)
        yield pd.DataFrame({k: [v] for k, v in made.items()})

    return run


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> dict:
    """The model, from labels (doc_id, toxic) outside the held-out part."""
    known = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.min("toxic").cast("int").alias("y")))
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class) for y in (0, 1)]
    drawn = written(drawn[0].unionByName(drawn[1]), "toxic-ids")
    share = known.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else float(share)
    # at most twice per_class ids, so they go to every task and only the drawn texts are moved
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    sample = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text", F.lit(share).alias("share"), F.xxhash64("doc_id").alias("h"), "doc_id")
    row = sample.repartition(1).sortWithinPartitions("h", "doc_id").select("y", "text", "share").mapInPandas(_fit_task(class_bytes), MODEL).first()
    return row.asDict() if row is not None else {"landmarks": [], "beta": [], "bias": 0.0, "logit": [0.0] * 4, "rows": 0}


def score_column(spark, text: Column, model: dict) -> Column:
    """The probability of label 1 of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        scorer, logit = Scorer(list(m["landmarks"]), np.array(m["beta"]), m["bias"]), np.array(m["logit"])
        for s in batches:
            out = []
            listed = s.tolist()
            for lo in range(0, len(listed), 250):
                docs = [Text(t) for t in listed[lo : lo + 250]]
                scorer.learn(docs)
                out += [1 / (1 + np.exp(-min(max(float(scorer.features(d) @ logit), -500.0), 500.0))) for d in docs]
            yield pd.Series(out, dtype="float64")

    return run(text.cast("string"))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score and predicted."""
    small_batches(docs.sparkSession)
    model = fit_model(docs, labels, per_class)
    made = F.struct(held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, F.col("text"), model).alias("score"))
    row = docs.select(*[F.col(c) for c in docs.columns if c not in ("held_out", "score", "predicted")], made.alias("toxic_made"))
    return row.select(*[c for c in row.columns if c != "toxic_made"], "toxic_made.held_out", "toxic_made.score", (F.col("toxic_made.score") >= threshold).cast("int").alias("predicted"))
