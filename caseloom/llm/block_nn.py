"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are quantised to int8 with a scale of their own.  Queries and
candidates are cut into blocks, and each pair of blocks is a tile: one matrix
product of int8 values (exact in float32 arithmetic, as every sum stays below
2^24 for up to 1040 components; longer vectors use float64).  With the norm
of each vector's rounding error the product bounds the true inner product
from both sides: |<x,y> - <x',y'>| <= |e_x||y'| + |x'||e_y| + |e_x||e_y|.
Within a tile only pairs whose upper bound reaches the k-th largest lower
bound survive; they are recomputed in double precision and kept in a heap of
k per query, and the heaps of a query's tiles are merged.

Exact copies are one candidate with its k + 1 smallest ids (further copies
cannot be among the k nearest, as ties go to smaller ids), and equal query
vectors are one query, so a group of copies of any size costs as one vector.
The result is exact for all vectors of one length; vectors are compared with
those of their own length only.

Handled: null, zero and non-finite vectors take no part; ties go to smaller
ids; an id that repeats is listed once; fewer than k candidates give all;
further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import written
from caseloom.llm.vectors import matrix, usable

#: Rows aimed at in a block of queries and of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 2048, 16384


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale, norm of the quantised row, norm of its error."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def tile_top(queries: np.ndarray, candidates: np.ndarray, k: int, stripe: int = 256) -> list[list[tuple[float, int]]]:
    """Per query its k largest inner products with the candidates, as (score,
    -position) heaps; ties go to smaller positions."""
    kind = np.float32 if queries.shape[1] <= 1040 else np.float64
    cq, cs, cn, ce = quantise(candidates)
    ct = cq.astype(kind).T
    out = []
    for at in range(0, len(queries), stripe):
        x = queries[at : at + stripe]
        q, s, n, e = quantise(x)
        near = (q.astype(kind) @ ct).astype(np.float64) * s[:, None] * cs[None, :]
        bound = np.outer(e, cn) + np.outer(n, ce) + np.outer(e, ce)
        bound += 1e-12 * (np.outer(n, cn) + bound)
        low = near - bound
        kth = np.partition(low, len(candidates) - k, axis=1)[:, len(candidates) - k] if len(candidates) > k else np.full(len(x), -np.inf)
        row, col = np.nonzero(near + bound >= kth[:, None])
        score = np.empty(len(row))
        for c in range(0, len(row), 1 << 17):
            r, d = row[c : c + (1 << 17)], col[c : c + (1 << 17)]
            score[c : c + (1 << 17)] = (x[r] * candidates[d]).sum(axis=1)
        heaps: list[list[tuple[float, int]]] = [[] for _ in x]
        for r, c, v in zip(row.tolist(), col.tolist(), score.tolist()):
            heap = heaps[r]
            if len(heap) < k:
                heapq.heappush(heap, (v, -c))
            elif (v, -c) > heap[0]:
                heapq.heapreplace(heap, (v, -c))
        out += heaps
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
            query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by inner product
    of every row that is a query, among all others."""
    c = F.col
    v = F.transform(c(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.filter(usable(vector)).filter(c(id_col).isNotNull()).select(c(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    # a vector's key: two 64-bit hashes of its components
    rows = rows.withColumn("key", F.concat_ws(":", F.hex(F.xxhash64(F.lit(1), "v")), F.hex(F.xxhash64(F.lit(2), "v")), F.size("v").cast("string")))
    rows = rows.dropDuplicates(["key", "id"])
    # the k + 1 smallest ids of a vector; Spark limits each task's part before the shuffle
    place = F.row_number().over(W.partitionBy("key").orderBy("id"))
    ids = written(rows.select("key", "id").withColumn("place", place).filter(c("place") <= k + 1).drop("place"), "nn-ids")
    distinct = written(rows.groupBy("key").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), F.max("is_query").alias("is_query")), "nn-vectors")
    size = distinct.agg(F.count(F.lit(1)), F.sum(c("is_query").cast("int"))).first()
    blocks = max(1, -(-size[0] // candidate_rows))
    q_blocks = max(1, -(-(size[1] or 0) // query_rows))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    # tiles: every query block meets every candidate block, each copied once for every block of the other kind
    left = distinct.filter("is_query").select("key", "v", block(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    right = distinct.select("key", "rep", "v", block(blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def tile(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("rep")
            for dim in sorted(set(q["v"].map(len))):
                qs, xs = q[q["v"].map(len) == dim], x[x["v"].map(len) == dim]
                if len(xs):
                    keys, reps = xs["key"].tolist(), xs["rep"].tolist()
                    # one more than k, as a query's own vector may be among them
                    for key, heap in zip(qs["key"].tolist(), tile_top(matrix(qs["v"]), matrix(xs["v"]), k + 1)):
                        out += [(key, keys[-p], reps[-p], s) for s, p in heap]
        return pd.DataFrame(out, columns=["q_key", "c_key", "c_rep", "score"])

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(tile, "q_key string, c_key string, c_rep long, score double")
    # vectors tied at the edge go by their smallest id: the vectors before one left out hold k better ids at least
    merged = F.row_number().over(W.partitionBy("q_key").orderBy(c("score").desc(), "c_rep"))
    best = best.withColumn("place", merged).filter(c("place") <= k + 1).drop("place")
    # vectors to ids: at most (k + 1) ids of each of the k + 1 vectors of a query vector
    best = best.join(ids.select(c("key").alias("c_key"), c("id").alias("vec_id")), "c_key")
    top = F.row_number().over(W.partitionBy("q_key").orderBy(c("score").desc(), "vec_id"))
    best = best.withColumn("place", top).filter(c("place") <= k + 1).drop("place")
    asked = rows.filter("is_query").select(c("key").alias("q_key"), c("id").alias("query_id"))
    found = asked.join(best, "q_key").filter(c("query_id") != c("vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(c("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(c("rank") <= k).select("query_id", "rank", "vec_id", "score")
