"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its five-word shingles (a shorter text is
one shingle of all its words), weight = occurrences.  Weight w of a shingle
is w unit regions, and darts fall into each region as a Poisson process in
rank: the arrivals depend on the hash of (shingle, region, dart) only, so
equal regions get equal darts in every document.  Only darts up to a rank of
T / total weight are thrown, T = K ln K + 2K, whatever the document's length;
a document with an empty coordinate throws on to twice the rank.  The dart
says which coordinate it hits, the earliest of each coordinate is the
signature, and two signatures agree at a coordinate with probability equal to
the weighted Jaccard similarity.

Signatures are banded: 16 bands of 4 find a pair of similarity 0.8 with
probability 0.9998 and more above.  Documents of equal sets are one class
first.  In each bucket the classes are compared with the bucket's first class,
by exact similarity over the full sets.  Classes that are then in the
component of that class need no test among themselves; the others are
compared with all of the bucket in tiles of two blocks that return
components, not pairs.  So a bucket of any size never emits all its pairs,
and no link between two classes that share a bucket is lost.

Handled: null and empty texts (no shingle: each such row stays alone), ties
and repeated rows (rows of one id and equal sets are one member), null ids
(rows stay alone and are kept), long texts, empty tables; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import mix64, rolling, small_batches, word_hashes, written
from caseloom.llm.components import components
from caseloom.llm.embedding_dedup import smallest_reachable

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
K = BANDS * ROWS
#: Classes of a block of the last comparison.
BLOCK = 512
SEED = np.uint64(0x243F6A8885A308D3)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all k-word shingles in order, repeats included."""
    h = word_hashes(text)
    return rolling(h, min(k, len(h))) if len(h) else h


def units(hashes: np.ndarray) -> np.ndarray:
    """The unit regions of a weighted set, ascending: the first occurrence of
    a hash is itself, the c-th is mixed with c."""
    s = np.sort(hashes)
    if len(s) < 2:
        return s
    new = np.concatenate([[True], s[1:] != s[:-1]])
    place = np.arange(len(s))
    copy = place - np.maximum.accumulate(np.where(new, place, 0))
    if copy.any():
        s = np.sort(np.where(copy > 0, mix64(s + copy.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), s))
    return s


def signature(region: np.ndarray, k: int = K) -> np.ndarray:
    """The earliest dart (its hash) of every coordinate."""
    limit = (k * np.log(k) + 2 * k) / len(region)
    best_time, best = np.full(k, np.inf), np.zeros(k, dtype=np.uint64)
    at, state = np.zeros(len(region)), mix64(region ^ SEED)
    live = np.arange(len(region))
    waiting_state, waiting_time = state, at
    while True:
        state, time = waiting_state, waiting_time
        over_s, over_t, hits_t, hits_s = [], [], [], []
        while len(state):
            # the next arrival of each live region
            nxt = mix64(state + np.uint64(0x9E3779B97F4A7C15))
            gap = -np.log(((nxt >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0)
            then = time + gap
            out = then > limit
            # a region beyond the limit waits as it was, to throw the same dart if the limit grows
            over_s.append(state[out])
            over_t.append(time[out])
            state, time = nxt[~out], then[~out]
            hits_t.append(time)
            hits_s.append(state)
        time, dart = np.concatenate(hits_t), mix64(np.concatenate(hits_s) ^ SEED)
        coordinate = (dart % np.uint64(k)).astype(np.int64)
        order = np.lexsort((time, coordinate))
        coordinate, time, dart = coordinate[order], time[order], dart[order]
        first = np.flatnonzero(np.concatenate([[True], coordinate[1:] != coordinate[:-1]])) if len(order) else order
        better = time[first] < best_time[coordinate[first]]
        put = first[better]
        best_time[coordinate[put]], best[coordinate[put]] = time[put], dart[put]
        if np.isfinite(best_time).all():
            return best
        limit *= 2
        waiting_state, waiting_time = np.concatenate(over_s), np.concatenate(over_t)


def bands(sig: np.ndarray, n: int = BANDS) -> np.ndarray:
    rows = sig.reshape(n, -1)
    out = np.arange(n, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for i in range(rows.shape[1]):
        out = mix64(out ^ rows[:, i]) * np.uint64(3)
    return out.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of unit regions."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def overlap(a: list[np.ndarray], b: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products
    of incidence matrices over the elements that both sides hold."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)))
    if not len(shared):
        return out

    def places(flat, sets):
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]

    (ra, ca), (rb, cb) = places(flat_a, a), places(flat_b, b)
    for lo in range(0, len(shared), chunk):
        parts = []
        for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            own = (c >= lo) & (c < lo + chunk)
            m = np.zeros((n, min(chunk, len(shared) - lo)), dtype=np.float32)
            m[r[own], c[own] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "text_hash", "key", "n_units", "bands"]
    for f in frames:
        rows = []
        for i, h, t in zip(f["doc_id"].tolist(), f["text_hash"].tolist(), f["text"].tolist()):
            u = units(shingles(t))
            if len(u):
                key = f"{int(np.bitwise_xor.reduce(mix64(u ^ SEED))):016x}{int(u.sum(dtype=np.uint64)):016x}{len(u):x}"
                rows.append((i, h, key, len(u), bands(signature(u)).tolist()))
        yield pd.DataFrame(rows, columns=names)


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"v": f["v"], "units": [units(shingles(t)).astype("<u8").tobytes() for t in f["text"].tolist()]})


def _verify(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [[np.frombuffer(x, dtype="<u8") for x in f[c].tolist()] for c in ("units_a", "units_b")]
            yield f[[similarity(x, y) >= threshold for x, y in zip(*sets)]][["a", "b"]]

    return run


def _tile(threshold: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        x, y = ([np.frombuffer(u, dtype="<u8") for u in f["units"].tolist()] for f in (left, right))
        both = overlap(x, y)
        nx, ny = np.array([len(u) for u in x]), np.array([len(u) for u in y])
        row, col = np.nonzero(both >= threshold * (nx[:, None] + ny[None, :] - both))
        ids = np.concatenate([left["v"].to_numpy(dtype=np.int64), right["v"].to_numpy(dtype=np.int64)])
        label = smallest_reachable(ids, row, col + len(left))
        some = label != ids
        return pd.DataFrame({"a": label[some], "b": ids[some]})

    return run


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (ids may repeat), and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def groups(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two written tables: members (doc_id, text_hash, v) of every document
    that has shingles, and the group (v, group, first_id, first_hash) of each
    class v, with the smallest id of the group."""
    c = F.col
    small_batches(docs.sparkSession)
    texts = identified(docs)
    signed = texts.filter("doc_id IS NOT NULL").mapInPandas(_sign, "doc_id long, text_hash long, key string, n_units long, bands array<long>")
    signed = written(signed.withColumn("v", F.xxhash64("key")).drop("key"), "dart-signatures")
    # documents of equal sets are one class; its first row stands for it
    classes = signed.groupBy("v").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_units").alias("n_units"), F.first("bands").alias("bands"))
    classes = written(classes.select("v", "rep.doc_id", "rep.text_hash", "n_units", "bands"), "dart-classes")
    places = classes.select("v", "n_units", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.min(F.struct("v", "n_units")).alias("p"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(shared.select("bucket", c("p.v").alias("pivot"), c("p.n_units").alias("pivot_units"), "n"), "dart-buckets")
    inside = written(places.join(shared, "bucket"), "dart-places")
    # the sets of the classes that meet any other
    met = inside.select("v").distinct().join(classes.select("v", "doc_id", "text_hash"), "v")
    sets = texts.join(met, ["doc_id", "text_hash"]).select("v", "text").mapInPandas(_units, "v long, units binary")
    sets = written(sets.dropDuplicates(["v"]), "dart-sets")
    # every class against the pivots of its buckets; sizes alone rule out some
    fits = (c("n_units") >= threshold * c("pivot_units")) & (c("pivot_units") >= threshold * c("n_units"))
    pairs = inside.filter((c("v") != c("pivot")) & fits).select(c("pivot").alias("a"), c("v").alias("b")).distinct()
    pairs = pairs.join(sets.select(c("v").alias("b"), c("units").alias("units_b")), "b").join(sets.select(c("v").alias("a"), c("units").alias("units_a")), "a")
    linked = written(pairs.mapInPandas(_verify(threshold), "a long, b long"), "dart-links")
    near = components(linked, "dart-near")
    # classes of a bucket that are not in the component of its pivot, against all others of the bucket
    comp = near.select(c("id").alias("v"), "component")
    at = inside.filter("n > 2").join(comp, "v", "left").join(near.select(c("id").alias("pivot"), c("component").alias("pivot_component")), "pivot", "left")
    apart = F.coalesce("component", "v") != F.coalesce("pivot_component", "pivot")
    at = written(at.filter("v != pivot").select("bucket", "v", "n", apart.alias("apart")), "dart-apart")
    open_ = at.groupBy("bucket").agg(F.sum(c("apart").cast("long")).alias("n_apart"), F.max("n").alias("n_all")).filter("n_apart > 0 AND n_all > 2")
    open_ = open_.select("bucket", F.ceil(c("n_apart") / block).cast("int").alias("na"), F.ceil(c("n_all") / block).cast("int").alias("nm"))
    at = at.select("bucket", "v", "apart").join(open_, "bucket").join(sets, "v")
    place = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    left = at.filter("apart").select("v", "units", "bucket", place("na").alias("i"), F.explode(F.sequence(F.lit(0), c("nm") - 1)).alias("j"))
    right = at.select(c("v").alias("v2"), c("units").alias("units2"), c("bucket").alias("bucket2"), F.explode(F.sequence(F.lit(0), c("na") - 1)).alias("i2"), place("nm").alias("j2"))
    run = _tile(threshold)
    tiles = left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket2", "i2", "j2")).applyInPandas(
        lambda a, b: run(a, b.rename(columns={"v2": "v", "units2": "units"})), "a long, b long")
    comp = components(linked.union(tiles), "dart-groups")
    group = classes.select("v", "doc_id", "text_hash").join(comp.select(c("id").alias("v"), "component"), "v", "left").withColumn("group", F.coalesce("component", "v"))
    group = written(group.select("v", "group", "doc_id", "text_hash"), "dart-class-groups")
    first = group.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("group", c("f.doc_id").alias("first_id"), c("f.text_hash").alias("first_hash"))
    return signed.select("doc_id", "text_hash", "v"), written(group.select("v", "group").join(first, "group"), "dart-firsts")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest id of its near-duplicate group, itself
    if it has none) and kept, one row per row of ``docs``."""
    members, group = groups(docs, threshold)
    found = members.join(group, "v").select("doc_id", F.col("first_id").alias("class_id"))
    # rows without shingles or without an id stand alone
    alone = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).alias("n"))
    alone = alone.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: the first (by id, then text hash) of
    each group, and every row without shingles or without an id."""
    c = F.col
    _, group = groups(docs, threshold)
    keep = group.select(c("first_id").alias("_keep_id"), c("first_hash").alias("_keep_hash")).distinct()
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("_row"), c("doc_id").cast("long").alias("_keep_id"), F.xxhash64(text).alias("_keep_hash"), text.rlike("[^\\x20\\x09-\\x0D]").alias("_said"))
    found = rows.join(keep, ["_keep_id", "_keep_hash"], "left_semi").filter("_said").dropDuplicates(["_keep_id", "_keep_hash"])
    alone = rows.filter("_keep_id IS NULL OR NOT _said")
    return found.select("_row.*").union(alone.select("_row.*"))
