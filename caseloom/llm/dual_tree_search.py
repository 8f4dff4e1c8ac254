"""Ranked lexical search by a dual-tree.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
A term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` over the N
documents that hold any term; a document gives a term of it the impact
``(10^9 tf) div (1000 tf + 8 m)`` with ``m = 100 - 90 + (90 n N) div L``.  A
score is the sum of weight times impact over an item's distinct terms, in
integers.

1. One pass reads every whole text and writes a profile per document: its
   number of terms, and the counts of those terms that some item holds.
2. Document frequencies are summed from the profiles; a weight per item term.
3. Search, in every task on its own part of the profiles: documents are put
   in an order that keeps alike ones together and become the leaves of a
   hierarchy (``FAN`` children a node); so do the items.  An item node holds,
   for every term, the greatest weight below it, a document node the greatest
   impact: the product of two nodes bounds every score below the pair.  Pairs
   are taken level by level; a pair whose bound is below the weakest of its
   items' kth scores is dropped with all it holds.  Pairs of leaves are scored
   exactly.  Every item keeps its k best documents of the task.
4. The k best of every task are ranked for each item.

The kth scores start from a first search in a small part of the profiles
(``SEED_SHARE``), which can only be below the final ones: nothing is lost, and
the second search reads all of the profiles.

Items come to the driver in blocks of ``BLOCK_ITEMS`` items and ``BLOCK_TERMS``
distinct terms at most, each searched in a pass of its own, so that what goes
to the executors is bounded; documents never leave theirs.  The rows of one
hierarchy of documents follow the block's terms (``CELLS`` numbers).  Products
are of whole numbers below 2^53, so floating point holds them exactly.

Defined results: a null text holds no terms; an item without terms has no
rows; the terms of rows of one item id are taken together; a null item id is
an item; documents with null id rank after all others of their score; rows of
a repeated doc_id are documents of their own; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import small_batches, written

LEAF, FAN = 16, 8
SEED_SHARE = 0.02
BLOCK_ITEMS, BLOCK_TERMS = 1024, 8192
#: Rows times terms of the profiles that one hierarchy holds.
CELLS = 6_000_000

#: Separators become blanks, A-Z small letters; all bytes of non-ASCII characters stay.
_TO = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TO).split()


def profiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms in all), ids and counts (of the vocabulary's terms,
    by id) of every document that holds a term; written."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf("n long, ids array<int>, counts array<int>")
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        number = shared.value
        for texts in batches:
            rows = []
            for t in texts.tolist():
                found = terms(t)
                held = Counter(map(number.get, found))
                held.pop(None, None)
                ids = sorted(held)
                rows.append((len(found), ids, [held[x] for x in ids]))
            yield pd.DataFrame(rows, columns=["n", "ids", "counts"])

    made = docs.select(F.col("doc_id").cast(doc_type).alias("doc_id"), profile(F.col("text").cast("string")).alias("p"))
    return written(made.select("doc_id", "p.*").filter("n > 0"), "search-profiles")


def tree(leaves: np.ndarray, fan: int = FAN) -> list[np.ndarray]:
    """Coordinate maxima by level: the leaves, their parents, ..., the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append(np.maximum.reduceat(low, np.arange(0, len(low), fan), axis=0))
    return levels


def similar_order(rows: np.ndarray) -> np.ndarray:
    """An order that puts rows next to each other whose heaviest coordinates
    agree."""
    if not len(rows):
        return np.zeros(0, dtype=int)
    a = rows.argmax(axis=1)
    rest = rows.copy()
    rest[np.arange(len(rows)), a] = -1
    return np.lexsort((rest.argmax(axis=1), a))


class Items:
    """The items' hierarchy and every item's k best documents so far."""

    def __init__(self, weights: np.ndarray, k: int, floors: np.ndarray):
        self.order = similar_order(weights)
        self.weights = weights[self.order].astype(np.float64)
        self.at = np.arange(0, len(weights), LEAF)
        self.levels = tree(np.maximum.reduceat(self.weights, self.at, axis=0))
        self.k, self.floor = k, floors[self.order].astype(np.float64)
        self.best: list[list[tuple]] = [[] for _ in weights]
        self.pairs = self.scored = 0

    def weakest(self) -> list[np.ndarray]:
        """The least kth score below every node."""
        low = np.minimum.reduceat(self.floor, self.at)
        out = [low]
        while len(out[-1]) > 1:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
        return out

    def search(self, ids: list, impact: np.ndarray) -> None:
        """Scores a batch of documents (rows of impact) against all items."""
        order = similar_order(impact * self.weights.max(axis=0))
        impact = impact[order]
        at = np.arange(0, len(impact), LEAF)
        docs = tree(np.maximum.reduceat(impact, at, axis=0))
        i, d = len(self.levels) - 1, len(docs) - 1
        a, b = np.array([0]), np.array([0])
        while True:
            least, keep_a, keep_b = self.weakest()[i], [], []
            for x in np.unique(a).tolist():
                mine = b[a == x]
                bound = docs[d][mine] @ self.levels[i][x]
                ok = (bound >= least[x]) & (bound > 0)
                self.pairs += len(mine)
                keep_a.append(np.full(int(ok.sum()), x))
                keep_b.append(mine[ok])
            a, b = np.concatenate(keep_a), np.concatenate(keep_b)
            if not len(a) or i == d == 0:
                break
            # the taller side is opened first
            if i >= d:
                a, b = self._open(a, b, len(self.levels[i - 1]))
                i -= 1
            else:
                b, a = self._open(b, a, len(docs[d - 1]))
                d -= 1
        for x in np.unique(a).tolist():
            # the nearest leaves first: they raise the kth scores
            lo, hi = x * LEAF, min((x + 1) * LEAF, len(self.weights))
            leaves = b[a == x]
            bound = docs[0][leaves] @ self.levels[0][x]
            for y in leaves[np.argsort(-bound, kind="stable")].tolist():
                if docs[0][y] @ self.levels[0][x] < self.floor[lo:hi].min():
                    break
                rows = slice(y * LEAF, min((y + 1) * LEAF, len(impact)))
                score = self.weights[lo:hi] @ impact[rows].T
                self.scored += score.size
                for r, c in zip(*np.nonzero((score >= self.floor[lo:hi, None]) & (score > 0))):
                    self._add(lo + int(r), int(score[r, c]), ids[int(order[y * LEAF + int(c)])])

    @staticmethod
    def _open(x: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Every node replaced by its children."""
        many = np.minimum(n - x * FAN, FAN)
        first = np.repeat(x * FAN, many)
        into = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return first + into, np.repeat(other, many)

    def _add(self, item: int, score: int, doc) -> None:
        best = self.best[item]
        best.append((-score, doc is None, doc if doc is not None else 0))
        if len(best) > self.k:
            best.sort()
            best.pop()
            self.floor[item] = max(self.floor[item], -best[-1][0])
        elif len(best) == self.k:
            self.floor[item] = max(self.floor[item], min(-x[0] for x in best))

    def rows(self) -> Iterator[tuple[int, object, int]]:
        for at, best in zip(self.order.tolist(), self.best):
            for score, none, doc in best:
                yield at, None if none else doc, -score


def _search(found: DataFrame, model: dict, k: int, floors: np.ndarray) -> DataFrame:
    """item (number), doc_id, score: the k best documents of every task."""
    shared = found.sparkSession.sparkContext.broadcast((model, floors))
    doc_type = found.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, floor = shared.value
        weights = np.zeros((len(m["items"]), len(m["w"])))
        for r, x in enumerate(m["items"]):
            weights[r, x] = m["w"][x]
        items = Items(weights, k, floor)
        n_docs, n_terms, tall = m["docs"], m["terms"], max(LEAF, CELLS // weights.shape[1])
        for f in frames:
            for lo in range(0, len(f), tall):
                part = f.iloc[lo : lo + tall]
                sizes = [len(x) for x in part["ids"]]
                if not sum(sizes):
                    continue
                row = np.repeat(np.arange(len(part)), sizes)
                col = np.concatenate([np.asarray(x, dtype=np.int64) for x in part["ids"]])
                tf = np.concatenate([np.asarray(x, dtype=np.int64) for x in part["counts"]])
                # the product of n and N may pass 64 bits: Python's integers
                long = np.array([10 + (90 * n * n_docs) // n_terms for n in part["n"].tolist()], dtype=np.int64)
                # only the block's terms take part: columns of other blocks are not here
                used = np.unique(row)
                impact = np.zeros((len(used), weights.shape[1]))
                impact[np.searchsorted(used, row), col] = (1_000_000_000 * tf) // (1000 * tf + 8 * long[row])
                ids = [None if x is None or x != x else int(x) if doc_type in ("bigint", "int", "smallint", "tinyint") else x for x in part["key"].tolist()]
                items.search([ids[x] for x in used.tolist()], impact)
        out = list(items.rows())
        yield pd.DataFrame({"item": pd.Series([x[0] for x in out], dtype="int32"), "key": pd.Series([None if x[1] is None else str(x[1]) for x in out], dtype="object"), "score": pd.Series([x[2] for x in out], dtype="int64")})

    # ids travel as text: a column with nulls would reach pandas as floats
    sent = found.select(F.col("doc_id").cast("string").alias("key"), "n", "ids", "counts")
    return sent.mapInPandas(run, "item int, key string, score long").select("item", F.col("key").cast(doc_type).alias("doc_id"), "score")


def _top(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def _blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[list[tuple]]:
    """Items (id, terms), by id, in blocks of so many items and distinct terms;
    an item with more terms is a block of its own."""
    block, vocabulary = [], set()
    for item, held in _merged(items):
        if block and (len(block) >= most_items or len(vocabulary | held) > most_terms):
            yield block
            block, vocabulary = [], set()
        block.append((item, held))
        vocabulary |= held
    if block:
        yield block


def _merged(items: DataFrame) -> Iterator[tuple]:
    last, held = None, set()
    ordered = items.select("item_id", F.col("text").cast("string").alias("text")).orderBy(F.col("item_id").asc_nulls_last())
    for row in ordered.toLocalIterator():
        if row["item_id"] != last and held:
            yield last, held
            held = set()
        last = row["item_id"]
        held |= set(terms(row["text"]))
    if held:
        yield last, held


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, seed_share: float = SEED_SHARE) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of
    every item (item_id, text)."""
    spark = docs.sparkSession
    item_type, doc_type = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    for block in _blocks(items, block_items, block_terms):
        vocabulary = {t: x for x, t in enumerate(sorted(set().union(*[held for _, held in block])))}
        found = profiles(docs, vocabulary)
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            return out
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for term, docs_with in found.select(F.explode("ids").alias("term")).groupBy("term").count().collect():  # bounded by the block's terms
            df[term] = docs_with
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        model = {"items": [np.array(sorted(vocabulary[t] for t in held)) for _, held in block], "w": weight, "docs": n_docs, "terms": n_terms}
        floors = np.zeros(len(block), dtype=np.int64)
        some = found.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1_000_000)) < int(seed_share * 1_000_000))
        for item, score in _top(_search(some, model, k, floors), k).filter(F.col("rank") == k).select("item", "score").collect():  # one row an item at most
            floors[item] = score
        names = spark.createDataFrame([(x, i) for x, (i, _) in enumerate(block)], f"item int, item_id {item_type}")
        best = _top(_search(found, model, k, floors), k).join(F.broadcast(names), "item")
        out = out.unionByName(written(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-best"))
    return out
