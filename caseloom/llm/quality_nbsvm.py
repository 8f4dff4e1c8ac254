"""Quality classifier: a linear SVM over naive Bayes support vectors.

A document is the set of its character n-grams (3 and 4 bytes of the UTF-8
text, white space folded, hashed) and of word bigrams backed off to "a word and
itself again", in steps of their share.  Each indicator is scaled by its class
log-count ratio and by the document's length (unit norm), and an L2-regular
hinge-loss model is fitted by dual coordinate descent.  Scores are made
probabilities by a sigmoid fitted on out-of-fold decision values, weighted to
the labels' own class frequencies.

The model is fitted on a bounded sample of labelled rows: the ``per_class``
rows of each class that come first by a hash of the id (drawn on the labels
alone; at most that many rows reach the fitting task), and of these the ones
whose n-grams fit into ``class_bytes`` together, first ones first.  Scoring
reads every whole text in place, without a shuffle.

Handled: null and empty texts (no features: the score of the bias), null or
repeated labels (dropped; the least label of an id counts, and of its texts the
one with the least set of n-grams), a missing class
(every score is the share of label 1, 0.5 without labels), null ids (never
labelled), repeated rows, long texts; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import word_hashes, written

BITS = 18
PER_CLASS = 3000
#: Bytes of n-grams of one class that the fit takes, 4 each.
CLASS_BYTES = 64_000_000
#: Added under the norm, so that texts with little evidence stay near the bias.
DAMP = 20.0
MODEL = "weights binary, bias double, slope double, shift double, rows long"


def features(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of a whole text, ascending."""
    raw = np.frombuffer(("" if text is None else text).encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int32)
    b = np.where((raw <= 32), 32, raw).astype(np.uint32)
    three = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    four = three[:-1] << np.uint32(8) | b[3:]
    keys = np.concatenate([three * np.uint32(0x9E3779B1), four * np.uint32(0x85EBCA6B) ^ np.uint32(0x5BD1E995)])
    keys = (keys ^ (keys >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    grams = (keys >> np.uint32(32 - BITS)).astype(np.int32)
    # word bigrams of a word with itself: one indicator for each power of two that their share reaches
    h = word_hashes(text)
    same = int((h[1:] == h[:-1]).sum())
    doubled = np.arange(max(1, int(np.ceil(np.log2(len(h) / same)))), 9, dtype=np.int32) if same else np.zeros(0, dtype=np.int32)
    return np.unique(np.concatenate([np.maximum(grams, 64), doubled]))


def log_count_ratio(docs: list[np.ndarray], label: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of documents with each indicator in class 1
    over class 0; an indicator that no document has says nothing (0)."""
    counts = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for x, y in zip(docs, label.tolist()):
        counts[y][x] += 1
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    a = alpha / min(n1, n0)
    return np.log(counts[1] / n1 + a) - np.log(counts[0] / n0 + a)


def dual_coordinate_descent(docs, values, label, cost: float = 1.0, epochs: int = 30, seed: int = 7, tolerance: float = 1e-3):
    """Hinge loss: min |w|^2/2 + C sum max(0, 1 - y w.x), solved in the dual one
    document at a time, each multiplier held in [0, C].  The bias is a constant
    feature.  Ends when no projected gradient of a pass exceeds ``tolerance``."""
    y = np.where(label == 1, 1.0, -1.0)
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(docs))
    q = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(docs)).tolist():
            x, v = docs[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1.0
            pg = min(g, 0.0) if alpha[i] <= 0.0 else max(g, 0.0) if alpha[i] >= cost else g
            if pg != 0.0:
                new = min(max(alpha[i] - g / q[i], 0.0), cost)
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[x] += step * v
                bias += step
                worst = max(worst, abs(pg))
        if worst < tolerance:
            break
    return w, bias


def fit_sigmoid(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1) = 1 / (1 + exp(-(slope * s + shift))), by
    Newton steps on the weighted log loss with softened targets."""
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -35, 35)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-12
        ga, gb = (g * score).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * score * score).sum() + 1e-3, (h * score).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return float(a), float(b)


def fit(docs: list[np.ndarray], label: np.ndarray, share_of_1: float, folds: int = 3):
    """Weights over indicators (ratio folded in), bias, slope and shift."""
    if len(set(label.tolist())) < 2:
        p = min(max(share_of_1 if len(label) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0, float(np.log(p / (1 - p)))

    def train(rows):
        mine = [docs[i] for i in rows]
        ratio = log_count_ratio(mine, label[rows])
        scaled = [ratio[x] / np.sqrt((ratio[x] ** 2).sum() + DAMP) for x in mine]
        w, bias = dual_coordinate_descent(mine, scaled, label[rows])
        return w, ratio, bias

    def decide(model, rows):
        w, ratio, bias = model
        return np.array([(w[x] * ratio[x]).sum() / np.sqrt((ratio[x] ** 2).sum() + DAMP) + bias for x in (docs[i] for i in rows)])

    everyone = np.arange(len(docs))
    fold = np.zeros(len(docs), dtype=int)
    for y in (0, 1):
        own = np.flatnonzero(label == y)
        fold[own] = np.arange(len(own)) % folds
    out = np.zeros(len(docs))
    for f in range(folds):
        rows = everyone[fold != f]
        if len(set(label[rows].tolist())) == 2:
            out[fold == f] = decide(train(rows), everyone[fold == f])
    weight = np.where(label == 1, share_of_1 / max((label == 1).mean(), 1e-9), (1 - share_of_1) / max((label == 0).mean(), 1e-9))
    slope, shift = fit_sigmoid(out, label, weight)
    w, ratio, bias = train(everyone)
    return (w, ratio), bias, slope, shift


def _fit_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    docs, label, share = [], [], 0.5
    for f in frames:
        docs += [np.frombuffer(x, dtype="<i4") for x in f["x"].tolist()]
        label += f["y"].tolist()
        share = float(f["share"].iloc[0]) if len(f) else share
    order = sorted(range(len(docs)), key=lambda i: (label[i], docs[i].tobytes()))  # whatever order the rows came in
    fitted, bias, slope, shift = fit([docs[i] for i in order], np.array([label[i] for i in order], dtype=int), share)
    w, ratio = fitted if isinstance(fitted, tuple) else (fitted, fitted)
    yield pd.DataFrame([(np.stack([w, ratio]).astype("<f4").tobytes(), bias, slope, shift, len(docs))], columns=["weights", "bias", "slope", "shift", "rows"])


def held_out(doc_id: Column, of: int = 4, remainder: int = 2) -> Column:
    """Whether an id belongs to the rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> dict:
    """The model, from labels (doc_id, quality) outside the held-out part."""
    spark = docs.sparkSession
    known = (labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").cast("int").alias("y")))
    # at most per_class + per_class ids
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class) for y in (0, 1)]
    drawn = written(drawn[0].unionByName(drawn[1]), "quality-ids")
    share = known.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else float(share)

    @F.pandas_udf(T.BinaryType())
    def grams(s: pd.Series) -> pd.Series:
        return s.map(lambda t: features(t).tobytes(), na_action=None)

    # the drawn ids are bounded by the parameter, so they go to every task and no text is shuffled
    texts = docs.select("doc_id", F.col("text").cast("string").alias("t")).join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    sample = texts.select("doc_id", "y", grams("t").alias("x")).groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("v"))
    sample = written(sample.select("doc_id", "v.x", F.col("v.y").cast("int").alias("y")), "quality-grams")
    # ids and sizes alone, at most per_class rows a class
    used = F.sum(F.octet_length("x")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = sample.select("doc_id", used.alias("used")).filter(F.col("used") <= class_bytes).select("doc_id")
    row = sample.join(F.broadcast(fits), "doc_id", "left_semi").select("x", "y", F.lit(share).alias("share")).repartition(1).mapInPandas(_fit_task, MODEL).first()
    if row is None:
        return {"weights": np.zeros((2, 1 << BITS), dtype="<f4").tobytes(), "bias": 0.0, "slope": 0.0, "shift": 0.0, "rows": 0}
    return row.asDict()


def score_column(spark, text: Column, model: dict) -> Column:
    """The probability of label 1 of a text."""
    shared = spark.sparkContext.broadcast({k: bytes(v) if k == "weights" else v for k, v in model.items()})

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        w, ratio = np.frombuffer(m["weights"], dtype="<f4").reshape(2, -1).astype(np.float64)
        both, square = w * ratio, ratio**2

        def one(t):
            x = features(t)
            s = both[x].sum() / np.sqrt(square[x].sum() + DAMP) + m["bias"]
            return 1 / (1 + np.exp(-min(max(m["slope"] * s + m["shift"], -500.0), 500.0)))

        for s in batches:
            yield pd.Series([one(t) for t in s.tolist()], dtype="float64")

    return run(text.cast("string"))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """``docs`` with held_out, score and predicted appended."""
    model = fit_model(docs, labels, per_class)
    out = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score_column(docs.sparkSession, F.col("text"), model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
