"""Embedding near-dedup by spherical k-means cells.

Equal vectors become one class.  Spherical k-means on a bounded sample gives
the cells; every class has the cell of its nearest centroid as home.  A pair
of cosine t or more may still lie on both sides of a border: if x is at home
in c and y in d, then <x, c - d> >= 0 >= <y, c - d>, and the two distances to
the plane between c and d add up to |x - y| <= sqrt(2 - 2t) at most.  A pair
beyond that is no link; no link is lost that way, whatever the centroids are.

Vectors are written once, sorted by cell and packed into blocks of rows with
the cells that each block's rows can have partners in.  Pairs of blocks that
can reach each other are read straight from that table, so neither the number
of cells nor that of blocks multiplies what lies on disk.  Within a pair of
blocks, tiles of two cells compare the rows near enough to the common border.

A tile first multiplies shortened rows: the leading coordinates in the
sample's principal directions, and the length of the rest, which bounds the
cosine from above.  What stays is multiplied whole in float32, and what is
within 1e-5 of the threshold is decided in double precision.  A pair of blocks
returns per row the number of linked vectors and the smallest id of its
component there, never the pairs.  Components are joined on Spark, and the
smallest id of each is kept.

For vectors without any structure the border test spares little and the work
nears that of comparing all blocks.

Handled: null, zero and non-finite vectors and those of null id link with
nothing (component: their id); vectors of other lengths are not compared;
rows that repeat count as vectors of their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import written
from caseloom.llm.components import components
from caseloom.llm.vectors import matrix, usable

SAMPLE_ROWS = 20_000
CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 8192, 1024, 2048
#: A packed block has so many tiles' rows and bytes at most, a file of blocks so many bytes.
PACK_TILES, PACK_BYTES, FILE_BYTES = 8, 4 << 20, 16 << 20
#: Rows and columns of one matrix product, so that it stays in the cache; the share of it from which whole rows are multiplied at once.
PRODUCT_ROWS, PRODUCT_COLS, DENSE = 256, 1024, 0.02
#: The share of unlinked pairs that shortened rows may leave.
SHORT_LEFT = 5e-4
SLACK = 1e-5
TILE = "id long, links long, component long"
PACK = "part long, width int, homes array<long>, meets array<long>, ids binary, ns binary, cells binary, vs binary"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit rows; an empty cell takes the row that is
    farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centre.T
        home = near.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        far = near.max(axis=1).argsort()[: len(empty)]
        total[empty], size[empty] = x[far], 1.0
        centre = total / size[:, None]
    return centre


def principal(x: np.ndarray, threshold: float, pairs: int = 1000) -> np.ndarray:
    """The leading principal directions of unit rows, as few as leave
    SHORT_LEFT of the sample's pairs; none where that takes half of all."""
    direction = np.linalg.eigh(x.T @ x)[1][:, ::-1].T
    a, b = x[:pairs], x[len(x) // 2 :][:pairs]
    for m in range(7, x.shape[1] // 2, 8):
        near = shortened(a, direction[:m]).astype(np.float64) @ shortened(b, direction[:m]).T
        if (near >= threshold - SLACK).mean() <= SHORT_LEFT + (a @ b.T >= threshold - SLACK).mean():
            return direction[:m]
    return direction[:0]


def shortened(x: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Coordinates in the directions, and the length of what is left; a
    product of two such rows is at least that of the unit rows."""
    y = x @ direction.T
    rest = np.sqrt(np.maximum(1 - (y * y).sum(axis=1, keepdims=True), 0))
    return np.hstack([y, rest]).astype(np.float32)


def cells_of(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Home cell of unit rows."""
    return (x @ centre.T).argmax(axis=1)


def depth(x: np.ndarray, home: np.ndarray, centre: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Distance of unit rows to the planes between their home and ``cells``,
    times the distance of the two centroids."""
    return np.einsum("ij,ij->i", x, centre[home])[:, None] - x @ centre[cells].T


def allowed(centre: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """How much the depths of a linked pair at home in the cells a and b may
    come to in all."""
    apart = np.sqrt(np.maximum(2 - 2 * (centre[a] @ centre[b].T), 0))
    return (np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6) * apart + 1e-6


class Rows:
    """Rows of a block: raw values, unit rows and shortened unit rows."""

    def __init__(self, raw: np.ndarray, x: np.ndarray, direction: np.ndarray):
        self.raw, self.whole = raw, x.astype(np.float32)
        self.short = shortened(x, direction) if len(direction) else self.whole


def at_least(near: np.ndarray, least: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the values from ``least`` on, few as a rule."""
    some = np.flatnonzero(near.max(axis=1) >= least)
    row, col = np.nonzero(near[some] >= least)
    return some[row], col


def compare(a: Rows, p: np.ndarray, b: Rows, q: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (row of a, row of b) with cosine >= threshold in double,
    among the rows p of a and q of b; the k-th PRODUCT_ROWS of p meet the
    first ends[k] of q."""
    least, sure = np.float32(threshold - SLACK), np.float32(threshold + SLACK)
    left, right = a.short[p], b.short[q]
    out = np.empty(PRODUCT_ROWS * PRODUCT_COLS, dtype=np.float32)
    for k, end in enumerate(ends):
        x, i = left[k * PRODUCT_ROWS : (k + 1) * PRODUCT_ROWS], p[k * PRODUCT_ROWS : (k + 1) * PRODUCT_ROWS]
        for e in range(0, end, PRODUCT_COLS):
            y, j = right[e : min(e + PRODUCT_COLS, end)], q[e : min(e + PRODUCT_COLS, end)]
            near = np.matmul(x, y.T, out=out[: len(x) * len(y)].reshape(len(x), len(y)))
            row, col = at_least(near, least)
            if a.short is not a.whole and DENSE * near.size < len(row):
                near = a.whole[i] @ b.whole[j].T
                row, col = at_least(near, least)
            elif a.short is not a.whole:
                cos = np.einsum("ij,ij->i", a.whole[i[row]], b.whole[j[col]])
                near[row, col] = cos
                row, col = row[cos >= least], col[cos >= least]
            if not len(row):
                continue
            close = np.flatnonzero(near[row, col] < sure)
            row, col, keep = i[row], j[col], np.ones(len(row), dtype=bool)
            u, v = a.raw[row[close]].astype(np.float64), b.raw[col[close]].astype(np.float64)
            keep[close] = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))) >= threshold
            yield row[keep], col[keep]


def smallest_reachable(label: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The smallest label in the component of each vertex of a small graph."""
    label = label.copy()
    while len(row):
        before = label.copy()
        np.minimum.at(label, row, label[col])
        np.minimum.at(label, col, label[row])
        if (label == before).all():
            break
    return label


def runs_of(cells: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Start and end of the runs of equal cells, at most ``most`` rows each."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
    return [(i, min(i + most, b)) for a, b in zip(edge[:-1], edge[1:], strict=True) for i in range(a, b, most)]


def near_border(da: np.ndarray, db: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two tiles whose depths can add up to ``most`` or less, the
    lowest depth first; and how many of the second are within reach of each
    PRODUCT_ROWS of the first."""
    a = np.flatnonzero(da <= most - db.min())
    b = np.flatnonzero(db <= most - da.min())
    a, b = a[da[a].argsort(kind="stable")], b[db[b].argsort(kind="stable")]
    return a, b, np.searchsorted(db[b], most - da[a[::PRODUCT_ROWS]], "right")


def block_links(a: dict, b: dict, same: bool, centre: np.ndarray, direction: np.ndarray, threshold: float, block_rows: int = BLOCK_ROWS) -> pd.DataFrame:
    """TILE rows of two blocks (ids, ns, cells, vs), one per row that has a
    link; ``same``: of one block with itself."""
    sides = [(s, unit(s["vs"].astype(np.float64))) for s in ((a,) if same else (a, b))]
    rows = [Rows(s["vs"], x, direction) for s, x in sides]
    met = [np.unique(s["cells"]) for s, _ in sides]
    deep = [depth(x, s["cells"], centre, met[-1 - k]) for k, (s, x) in enumerate(sides)]
    most = allowed(centre, met[0], met[-1], threshold)
    first = 0 if same else len(a["ids"])  # of the second side in what is counted
    ids, n = (np.concatenate([s[x] for s, _ in sides]) for x in ("ids", "ns"))
    order = ids.argsort(kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    links, edges = np.zeros(len(ids), dtype=np.int64), [(np.zeros(0, dtype=np.int64),) * 2]
    tiles = [runs_of(s["cells"], block_rows) for s, _ in sides]
    for i, (a0, a1) in enumerate(tiles[0]):
        for b0, b1 in tiles[-1][i if same else 0 :]:
            ca, cb = (np.searchsorted(m, s["cells"][at]) for m, (s, _), at in ((met[0], sides[0], a0), (met[-1], sides[-1], b0)))
            p, q, ends = near_border(deep[0][a0:a1, cb], deep[-1][b0:b1, ca], most[ca, cb])
            at = np.concatenate([np.arange(a0, a1), np.arange(first + b0, first + b1)])
            for row, col in compare(rows[0], a0 + p, rows[-1], b0 + q, ends, threshold):
                if same and a0 == b0:
                    row, col = row[row < col], col[row < col]
                more = np.bincount(row - a0, weights=n[first + col], minlength=a1 - a0), np.bincount(col - b0, weights=n[row], minlength=b1 - b0)
                links[a0:a1] += more[0].astype(np.int64)
                links[first + b0 : first + b1] += more[1].astype(np.int64)
                some = np.flatnonzero(np.concatenate(more))
                edges.append((at[some], order[smallest_reachable(rank[at], row - a0, a1 - a0 + col - b0)[some]]))
    label = smallest_reachable(rank, *(np.concatenate(x) for x in zip(*edges, strict=True)))
    some = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[some], "links": links[some], "component": ids[order[label[some]]]})


def link_classes(classes: DataFrame, sample: DataFrame, sizes: dict[int, int], threshold: float, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """TILE rows of the classes (id, n, width, v), several per class: linked
    vectors of other classes, and an edge towards its component.  sample:
    classes that the cells come from; sizes: the number of classes by width."""
    spark, c = classes.sparkSession, F.col
    kind = np.dtype(np.float32 if classes.schema["v"].dataType.elementType.typeName() == "float" else np.float64)
    k_of = {w: min(MOST_CELLS, max(1, -(-n // cell_rows))) for w, n in sizes.items()}

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        x = unit(matrix(f.sort_values("id")["v"]))
        centre, direction = spherical_kmeans(x, min(k_of.get(x.shape[1], 1), len(x))), principal(x, threshold)
        return pd.DataFrame({"width": x.shape[1], "centre": [True] * len(centre) + [False] * len(direction), "v": [*centre, *direction]})

    # the cells come from a bounded sample; all classes are then assigned
    found: dict[tuple[int, bool], list] = {}
    for r in sample.groupBy("width").applyInPandas(fit, "width int, centre boolean, v array<double>").collect():
        found.setdefault((r[0], r[1]), []).append(r[2])
    shapes = spark.sparkContext.broadcast({k: np.array(v) for k, v in found.items()})

    def shape(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and principal directions; one cell where the sample has
        no vector of that width."""
        return shapes.value.get((width, True), np.ones((1, width)) / np.sqrt(width)), shapes.value.get((width, False), np.zeros((0, width)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, g in f.groupby("width"):
                x = matrix(g["v"])
                yield g.assign(cell=cells_of(unit(x), shape(width)[0]).astype("int32"), v=[r.tobytes() for r in x.astype(kind)])[["id", "n", "width", "cell", "v"]]

    def block(width: int, part: int, f: pd.DataFrame) -> dict:
        centre = shape(width)[0]
        raw, cells = b"".join(f["v"]), f["cell"].to_numpy(dtype=np.int32)
        x, meets = unit(np.frombuffer(raw, dtype=kind).reshape(-1, width).astype(np.float64)), np.zeros(len(centre), dtype=bool)
        for i in range(0, len(x), BLOCK_ROWS):
            own = cells[i : i + BLOCK_ROWS]
            meets |= (depth(x[i : i + BLOCK_ROWS], own, centre, np.arange(len(centre))) <= allowed(centre, own, np.arange(len(centre)), threshold)).any(axis=0)
        code = lambda some: [width * MOST_CELLS + int(i) for i in some]
        return {"part": part, "width": width, "homes": code(np.unique(cells)), "meets": code(np.flatnonzero(meets)), "ids": f["id"].to_numpy(dtype=np.int64).tobytes(), "ns": f["n"].to_numpy(dtype=np.int64).tobytes(), "cells": cells.tobytes(), "vs": raw}

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId() << 32, pd.DataFrame()
        for f in chain(frames, [None]):
            held = held if f is None else pd.concat([held, f], ignore_index=True) if len(held) else f
            while len(held):
                width = int(held["width"].iloc[0])
                own = int((held["width"] == width).sum())  # sorted by width
                most = max(1, min(PACK_TILES * block_rows, PACK_BYTES // (width * kind.itemsize)))
                if own < most and own == len(held) and f is not None:
                    break
                yield pd.DataFrame([block(width, part, held.iloc[: min(own, most)])])
                part, held = part + 1, held.iloc[min(own, most) :]

    total, stored = sum(sizes.values()), sum(n * w * kind.itemsize for w, n in sizes.items())
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-total // block_rows)), -(-stored // FILE_BYTES))
    members = classes.select("id", "n", "width", "v").mapInPandas(assign, "id long, n long, width int, cell int, v binary")
    order = ["width", "cell", "id"]
    blocks = written(members.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(pack, PACK), "vector-blocks")
    # a pair of blocks is taken one way round, whichever, so that tasks get like shares
    other = blocks.toDF(*[f"{x}_2" for x in blocks.columns])
    low, high = F.least("part", "part_2"), F.greatest("part", "part_2")
    even = F.pmod(F.xxhash64(low, high), F.lit(2)) == 0
    once = F.when(even, c("part") <= c("part_2")).otherwise(c("part") >= c("part_2"))
    pairs = blocks.join(other, once & F.arrays_overlap("homes", "meets_2") & F.arrays_overlap("meets", "homes_2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"ids": np.int64, "ns": np.int64, "cells": np.int32, "vs": kind}
        for f in batches:
            for k in range(f.num_rows):
                width, same = f.column("width")[k].as_py(), f.column("same")[k].as_py()
                a, b = ({x: np.frombuffer(f.column(x + y)[k].as_buffer(), dtype=d) for x, d in kinds.items()} for y in ("", "_2"))
                a["vs"], b["vs"] = a["vs"].reshape(-1, width), b["vs"].reshape(-1, width)
                yield pa.RecordBatch.from_pandas(block_links(a, b, same, *shape(width), threshold, block_rows), preserve_index=False)

    payload = [x + y for y in ("", "_2") for x in ("ids", "ns", "cells", "vs")]
    return pairs.select("width", (c("part") == c("part_2")).alias("same"), *payload).mapInArrow(run, TILE)


def dedup(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, **sizes) -> DataFrame:
    """id_col, n_links, component_id, kept: one row per row of ``vectors``."""
    c, key = F.col, ["h1", "h2", "width"]
    kind = "float" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "double"
    v = F.transform(c(vector), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    rows = vectors.select(c(id_col).alias("id0"), F.when(usable(vector) & c(id_col).isNotNull(), v).alias("v")).withColumn("id", c("id0").cast("long"))
    known = c("v").isNotNull()
    rows = rows.select("id0", "id", "v", F.when(known, F.xxhash64(F.lit(1), "v")).alias("h1"), F.when(known, F.xxhash64(F.lit(2), "v")).alias("h2"), F.when(known, F.size("v")).alias("width"))
    # vectors are read from the input where they are needed; all else from their keys
    keys = written(rows.select("id0", "id", *key), "vector-keys")
    classes = written(keys.filter("h1 IS NOT NULL").groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes")
    count = {r[0]: r[1] for r in classes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1000).collect()}
    good = rows.filter("v IS NOT NULL")
    mixed = F.xxhash64("h1", "h2")
    sample = good.filter(F.pmod(mixed, F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 1.5 * sample_rows / max(1, sum(count.values())))) + 1)).dropDuplicates(key).orderBy(mixed).limit(sample_rows)
    full = good.groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min_by("v", "id").alias("v"))
    links = written(link_classes(full, sample, count, threshold, **sizes), "vector-links")
    own = links.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(links.select(c("id").alias("a"), c("component").alias("b")), "vector-components")
    per = (classes.join(own, "id", "left").join(comp, "id", "left").filter("n > 1 OR links IS NOT NULL")
           .select(*key, (F.coalesce("links", F.lit(0)) + c("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = keys.join(per, key, "left")
    component = F.coalesce("component_id", "id")
    return out.select(c("id0").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(c("id") == component, F.lit(True)).alias("kept"))
