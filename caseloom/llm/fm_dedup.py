"""Substring dedup with a compressed FM-index per shard.

A window is ``length`` consecutive words of one document; every word under a
window whose words also start elsewhere is removed.

Comparing every document with the index of every shard would cost documents
times shards.  Instead each window belongs to one anchor, the smallest hash
among its 8-word grams (equal windows have equal anchors), an anchor that
occurs once in the corpus rules its windows out, and the rest are dealt to
shards by anchor: each run of windows of one anchor travels as one segment of
words.  Equal texts are one text with a weight before that, and equal
segments are one segment with a weight, so a passage that a third of all
documents hold is indexed once.  An anchor whose different segments have more
words than a share of a shard has the windows of those segments dealt one by
one, by their own hash, equal windows being one again, and so spreads over all
shards.  An anchor in very many texts goes that way from the start.

A shard sorts the suffixes of its segments (prefix doubling), takes the
Burrows-Wheeler transform into a bit-packed wavelet matrix, and streams all
segments through it from right to left by backward search, one step per word.
The matching statistic is kept up to ``length``: at full length the interval
is first widened to its prefix of one word less.  Windows whose interval
holds two or more weighted occurrences are reported.

Words are compared by 40 bits of a 64-bit hash (a false match needs a
collision inside otherwise equal windows).

Handled: null, empty and short texts (nothing removed), long texts, repeated
rows and ids (each row counts), null ids, empty tables; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import mix64, rolling, small_batches, word_hashes, written

LENGTH, GRAM = 35, 8
#: Words aimed at in a shard; segments of one anchor beyond which its windows go one by one from the start.
SHARD_WORDS, HOT_SEGMENTS = 600_000, 1_000_000
#: Part of a shard that the different segments of one anchor may fill; beyond, their windows go one by one.
ANCHOR_PART = 4


def window_anchors(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the word hashes of a text: the gram hashes, and the position of the
    (leftmost) smallest gram of every window."""
    g = rolling(h, gram)
    if len(h) < length:
        return g, np.zeros(0, dtype=np.int64)
    width = length - gram + 1
    # smallest over a growing span by doubling; ties go left
    at, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        span += step
    return g, at


def pack(words: np.ndarray) -> bytes:
    """40 bits of each word hash."""
    return (words & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((words >> np.uint64(32)) & np.uint64(255)).astype("u1").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, dtype="<u4", count=n).astype(np.uint64) | np.frombuffer(raw, dtype="u1", offset=4 * n).astype(np.uint64) << np.uint64(32)


class BitRank:
    """A bit vector of packed 64-bit words with the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class FMIndex:
    """The index of a list of weighted sequences of small integers >= 1."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, length: int):
        n_seq, size = len(sequences), np.array([len(s) for s in sequences])
        text = np.zeros(int(size.sum()) + n_seq, dtype=np.int64)
        ends = np.cumsum(size + 1) - 1
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = np.concatenate(sequences)
        n, self.length = len(text), length
        # every end mark ranks by itself, below all words
        rank = np.where(inside, text + n_seq, 0)
        rank[ends] = np.arange(n_seq)
        order = np.argsort(rank, kind="stable")
        rank = self._ranks(rank[order], order)
        spans, span = {1: rank}, 1
        while span <= size.max():
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - span] = rank[span:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key[order], order)
            span *= 2
            spans[span] = rank
        self.order = order
        # where the first length - 1 words change along the order
        part = max(s for s in spans if s <= max(1, length - 1))
        head, shift = spans[part], max(0, length - 1 - part)
        tail = np.full(n, -1, dtype=np.int64)
        tail[: max(0, n - shift)] = head[shift:]
        a, b = head[order], tail[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        place = np.arange(n)
        self.left = np.maximum.accumulate(np.where(new, place, 0))
        starts = np.flatnonzero(new)
        self.right = np.append(starts[1:], n)[np.cumsum(new) - 1]
        weight = np.repeat(weights, size + 1)[order]
        self.mass = np.concatenate([[0], np.cumsum(weight)])
        bwt = text[order - 1]  # before the first word stands the last end mark
        self.levels, self.sigma = [], int(text.max()) + 1
        value = bwt
        for bit in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (value >> bit) & 1
            level = BitRank(ones.astype(np.uint8))
            self.levels.append((bit, level))
            value = np.concatenate([value[ones == 0], value[ones == 1]])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.base = self._descend(np.arange(self.sigma), np.zeros(self.sigma, dtype=np.int64))
        self.n = n

    @staticmethod
    def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        return out

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, level in self.levels:
            ones = level.rank(at)
            at = np.where((symbol >> bit) & 1 == 1, level.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + match, from those of match."""
        shift = self.first[symbol] - self.base[symbol]
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def repeated(self, streams: list[np.ndarray], least: int = 2) -> list[np.ndarray]:
        """Per stream the starts of windows with ``least`` or more weighted
        occurrences.  A stream holds symbols of the index (0: none)."""
        size = np.array([len(s) for s in streams])
        by = np.argsort(-size, kind="stable")
        flat, begin = np.concatenate([streams[i] for i in by]), np.cumsum(size[by]) - size[by]
        size = size[by]
        lo, hi = np.zeros(len(by), dtype=np.int64), np.full(len(by), self.n, dtype=np.int64)
        matched = np.zeros(len(by), dtype=np.int64)
        hits_lane, hits_at = [], []
        for back in range(1, int(size.max()) + 1 if len(size) else 1):
            live = int(np.searchsorted(-size, -back, side="right"))
            l, h, m = lo[:live], hi[:live], matched[:live]
            full = m == self.length
            l = np.where(full, self.left[np.minimum(l, self.n - 1)], l)
            h = np.where(full, self.right[np.maximum(h - 1, 0)], h)
            m = m - full
            at = size[:live] - back
            symbol = flat[begin[:live] + at]
            l, h = self.extend(symbol, l, h)
            # a word that the index lacks, or one that breaks the match: begin anew behind it
            gone = (h <= l) | (symbol == 0)
            l, h, m = np.where(gone, 0, l), np.where(gone, self.n, h), np.where(gone, 0, m + 1)
            lo[:live], hi[:live], matched[:live] = l, h, m
            hit = np.flatnonzero((m == self.length) & (self.mass[h] - self.mass[l] >= least))
            hits_lane.append(hit)
            hits_at.append(at[hit])
        lane = np.concatenate(hits_lane) if hits_lane else np.zeros(0, dtype=np.int64)
        where = np.concatenate(hits_at) if hits_at else lane
        out = [np.zeros(0, dtype=np.int64)] * len(by)
        order = np.lexsort((where, lane))
        lane, where = lane[order], where[order]
        cut = np.flatnonzero(np.diff(lane)) + 1
        for i, w in zip(np.split(lane, cut), np.split(where, cut)):
            if len(i):
                out[by[i[0]]] = w
        return out


def shard_repeats(segments: list[np.ndarray], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """Starts of the repeated windows of each segment of word hashes."""
    _, ids = np.unique(np.concatenate(segments), return_inverse=True)
    cuts = np.cumsum([len(s) for s in segments])[:-1]
    coded = np.split(ids.astype(np.int64) + 1, cuts)
    return FMIndex(coded, weights, length).repeated(coded)


def _texts(docs: DataFrame, id_col: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), text.alias("text"))


def deal(segments: DataFrame, shard_words: int) -> DataFrame:
    """With the shard of each segment, by its route."""
    total = segments.agg(F.sum(F.octet_length("words") / 5)).first()[0] or 0
    shards = max(1, int(-(-total // shard_words)))
    return segments.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT_SEGMENTS, id_col: str = "doc_id") -> DataFrame:
    """t1, t2 (hashes of a text) and spans: the word spans (start, end), in
    any order, that repeated windows cover, for every text that has some."""
    c = F.col
    small_batches(docs.sparkSession)
    texts = _texts(docs, id_col)

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f["text"].tolist():
                g, at = window_anchors(word_hashes(t), length, gram)
                out.append(g[np.unique(at)].astype(np.int64).tolist() if len(at) else [])
            yield f[["doc_id", "t1", "t2"]].assign(anchors=out)

    found = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63) + 1))).mapInPandas(anchors, "doc_id long, t1 long, t2 long, anchors array<long>")
    # equal texts are one, of the smallest id, with a weight
    found = found.filter(F.size("anchors") > 0).groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors"))
    found = written(found, "fm-anchors")
    each = found.select("t1", "t2", "doc_id", "n", F.explode("anchors").alias("anchor"))
    often = each.groupBy("anchor").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("texts")).filter("weight > 1").select("anchor", (c("texts") > hot).alias("hot"))
    often = written(often, "fm-repeated")  # so that the join deals both sides anew and can split a frequent anchor
    mine = each.join(often, "anchor").groupBy("t1", "t2", "doc_id", "n").agg(
        F.collect_set(F.when(~c("hot"), c("anchor"))).alias("anchors"), F.collect_set(F.when(c("hot"), c("anchor"))).alias("hot"))
    mine = written(mine, "fm-candidates")

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["t1", "t2", "n", "start", "route", "words"]
        for f in frames:
            rows, held = [], 0
            for t1, t2, n, cold, warm, t in zip(*(f[x].tolist() for x in ("t1", "t2", "n", "anchors", "hot", "text"))):
                h = word_hashes(t)
                g, at = window_anchors(h, length, gram)
                cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                ends = np.append(cuts[1:], len(at))
                runs = g[at[cuts]].astype(np.int64)
                for i in np.flatnonzero(np.isin(runs, np.array(cold, dtype=np.int64))).tolist():
                    a, b = int(cuts[i]), int(ends[i]) + length - 1
                    rows.append((t1, t2, n, a, int(runs[i]), pack(h[a:b])))
                    held += b - a
                if len(warm):
                    own = mix64(rolling(h, length)).astype(np.int64)
                    for i in np.flatnonzero(np.isin(runs, np.array(warm, dtype=np.int64))).tolist():
                        rows += [(t1, t2, n, a, int(own[a]), pack(h[a : a + length])) for a in range(int(cuts[i]), int(ends[i]))]
                        held += length * int(ends[i] - cuts[i])
                if held > 2_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    one = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63) + 1))).join(mine, ["t1", "t2", "doc_id"]).dropDuplicates(["t1", "t2", "doc_id"])
    parts = one.select("t1", "t2", "n", "anchors", "hot", "text").mapInPandas(segments, "t1 long, t2 long, n long, start long, route long, words binary")
    parts = parts.withColumn("k1", F.xxhash64(F.lit(1), "words")).withColumn("k2", F.xxhash64(F.lit(2), "words"))
    parts = written(parts, "fm-segments")
    distinct = parts.groupBy("k1", "k2").agg(F.first("route").alias("route"), F.sum("n").alias("n"), F.first("words").alias("words"))
    distinct = written(distinct, "fm-distinct")
    # an anchor beside many different words would fill a shard alone: its windows go one by one
    count = F.octet_length("words") / 5
    wide = distinct.groupBy("route").agg(F.sum(count).alias("words"), F.max(count).alias("longest"))
    wide = written(wide.filter((c("words") > shard_words / ANCHOR_PART) & (c("longest") > length)).select("route"), "fm-wide")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["k1", "k2", "n", "first", "route", "words"]
        for f in frames:
            rows, held = [], 0
            for k1, k2, n, raw in zip(*(f[x].tolist() for x in ("k1", "k2", "n", "words"))):
                h = unpack(raw)
                own = mix64(rolling(h, length)).astype(np.int64).tolist()
                rows += [(k1, k2, n, a, own[a], pack(h[a : a + length])) for a in range(len(own))]
                held += length * len(own)
                if held > 2_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    spread = not wide.isEmpty()
    searched = distinct.withColumn("single", F.lit(False))
    if spread:
        singles = distinct.join(wide, "route", "left_semi").select("k1", "k2", "n", "words").mapInPandas(windows, "k1 long, k2 long, n long, first long, route long, words binary")
        singles = singles.withColumn("w1", F.xxhash64(F.lit(1), "words")).withColumn("w2", F.xxhash64(F.lit(2), "words"))
        once = singles.groupBy(c("w1").alias("k1"), c("w2").alias("k2")).agg(F.first("route").alias("route"), F.sum("n").alias("n"), F.first("words").alias("words"))
        once = written(once.withColumn("single", F.lit(True)), "fm-windows")
        searched = searched.join(wide, "route", "left_anti").unionByName(once)

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["k1", "k2"])
        starts = shard_repeats([unpack(w) for w in f["words"].tolist()], f["n"].to_numpy(dtype=np.int64), length)
        out = []
        for k1, k2, single, s in zip(f["k1"].tolist(), f["k2"].tolist(), f["single"].tolist(), starts):
            if len(s):
                new = np.flatnonzero(np.concatenate([[True], np.diff(s) > 1]))
                last = np.append(new[1:], len(s)) - 1
                out += [(k1, k2, single, a, b + length) for a, b in zip(s[new].tolist(), s[last].tolist())]
        return pd.DataFrame(out, columns=["k1", "k2", "single", "first", "past"])

    hits = written(deal(searched, shard_words).groupBy("shard").applyInPandas(search, "k1 long, k2 long, single boolean, first long, past long"), "fm-hits")
    if spread:  # from windows back to the segments that hold them
        found = hits.filter("single").select(c("k1").alias("w1"), c("k2").alias("w2"))
        found = singles.select("k1", "k2", "first", "w1", "w2").join(found, ["w1", "w2"]).select("k1", "k2", "first", (c("first") + length).alias("past"))
        hits = written(hits.filter("not single").select("k1", "k2", "first", "past").union(found), "fm-found")
    at = parts.select("t1", "t2", "start", "k1", "k2").join(hits, ["k1", "k2"])
    return at.groupBy("t1", "t2").agg(F.collect_list(F.struct((c("start") + c("first")).alias("start"), (c("start") + c("past")).alias("end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", full: bool = True, **sizes) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 and (if full) kept, the words
    that stay joined by one space: one row per row of ``docs``."""
    spans = written(repeated_spans(docs, length, id_col=id_col, **sizes), "fm-spans")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t, s in zip(f["text"].tolist(), f["spans"].tolist()):
                words = t.encode("utf-8", "replace").split()
                total = len(words)
                if s is not None and len(s):
                    gone = np.zeros(total + 1, dtype=np.int64)
                    np.add.at(gone, [x["start"] for x in s], 1)
                    np.add.at(gone, [x["end"] for x in s], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone)[:total].tolist()) if not g]
                kept = b" ".join(words)
                rows.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if full else None))
            yield pd.concat([f[["id_text"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])], axis=1)

    kind = docs.schema[id_col].dataType
    rows = _texts(docs, id_col).join(spans, ["t1", "t2"], "left").select(F.col("doc_id").cast("string").alias("id_text"), "text", "spans")
    out = rows.mapInPandas(cut, "id_text string, n_words long, n_removed long, kept_sha256 string, kept string")
    out = out.select(F.col("id_text").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")
    return out if full else out.drop("kept")
