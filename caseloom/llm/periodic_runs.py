"""Periodic run detection: suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, of at least
``max(LEAST, POWER * q)`` words, that no neighbouring word extends.

The suffix automaton of the word sequence is built; its suffix links form a
tree in which the ancestors of the state of prefix i are the suffixes of that
prefix.  Words are then appended one after another: appending word i accesses
the path from its state to the root and recolours it with i.  Before that, the
path consists of segments of one colour each; a segment of colour j whose
deepest state has length L says that the last L words before i stood last
before j.  With d = i - j, d <= L is a square of period d; it is extended to a
run, here where L + d reaches the least length, at the i where the run ends.

Access keeps preferred paths as stacks of coloured intervals on the heavy
paths of the link tree: a recolouring covers a prefix of each heavy path that
it meets, so covered intervals are popped and one is pushed.  A path to the
root meets a logarithmic number of heavy paths, which bounds the intervals
that an appended word makes, whatever the depth (a text of one word alone has
a path as deep as the text).

Words that occur fewer than ``POWER`` times in a stretch can't belong to a run
in it: every residue of the period occurs that often.  Texts are first cut at
such words, again and again until nothing changes, in numpy over a whole batch
at once; automata are built of the remaining pieces only.  No run is lost.

Handled: null and empty texts (no words, no runs), null ids (no periodic
tail), repeated rows (each on its own), long texts (memory grows with the
longest piece, about 600 bytes a word), empty tables (no rows).  The output
columns are new ones only; a document column of the same name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import small_batches

LEAST, POWER = 6, 4
RUNS = "run_words long, run_list array<struct<start:long,length:long,period:long>>, run_collapsed string"


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def pieces(ids: np.ndarray, doc: np.ndarray, power: int = POWER, least: int = LEAST, rounds: int = 64) -> list[tuple[int, int]]:
    """[start, end) of the stretches that can hold runs: no word in them
    occurs fewer than ``power`` times in its stretch.  ids: word numbers of
    one or more documents, doc: their document's number, ascending."""
    at = np.arange(len(ids))
    for _ in range(rounds):
        if not len(at):
            return []
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(doc[at]) != 0)
        part = np.cumsum(new) - 1
        size = np.bincount(part)
        key = part.astype(np.int64) * (int(ids.max()) + 1) + ids[at]
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.empty(len(k), dtype=np.int64)
        count[order] = np.repeat(np.diff(np.append(first, len(k))), np.diff(np.append(first, len(k))))
        keep = (count >= power) & (size[part] >= least)
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(doc[at]) != 0)
    start = at[new]
    end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + 1
    return list(zip(start.tolist(), end.tolist()))


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """link and length of every state, and the state of every prefix."""
    link, length, step, prefix = [-1], [0], [{}], []
    last = 0
    for c in s:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        prefix.append(new)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return link, length, prefix


def heavy_paths(link: list[int], length: list[int]) -> list[int]:
    """The top state of every state's heavy path."""
    n = len(link)
    order = np.argsort(np.array(length), kind="stable").tolist()
    size = [1] * n
    for v in reversed(order[1:]):
        size[link[v]] += size[v]
    heavy, most = [-1] * n, [0] * n
    for v in order[1:]:
        p = link[v]
        if size[v] > most[p]:
            most[p], heavy[p] = size[v], v
    top = [0] * n
    for v in order[1:]:
        p = link[v]
        top[v] = top[p] if heavy[p] == v else v
    return top


def find_runs(s: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period."""
    n = len(s)
    if n < least:
        return []
    link, length, prefix = automaton(s)
    top = heavy_paths(link, length)
    # for each heavy path (by its top) intervals from the deepest to the shallowest: [length of its deepest state, colour]
    painted: dict[int, list[list[int]]] = {}
    found: dict[tuple[int, int], int] = {}
    for i in range(n):
        v = prefix[i]
        while v > 0:
            t, depth = top[v], length[v]
            stack = painted.get(t)
            if stack is None:
                painted[t] = [[depth, i]]
            else:
                # the shallowest intervals are at the end of the list
                while stack:
                    deepest, j = stack[-1]
                    seen, d = min(deepest, depth), i - j
                    # a square of period d whose two ends are seen suffix lengths apart, extended to a run that ends here
                    if seen >= d and seen + d >= least and seen >= (power - 1) * d and (i + 1 == n or s[i + 1] != s[i + 1 - d]):
                        start = j - seen + 1
                        while start > 0 and s[start - 1] == s[start - 1 + d]:
                            start -= 1
                        key = (start, i)
                        if d < found.get(key, n):
                            found[key] = d
                    if deepest > depth:
                        break  # the part below keeps its colour
                    stack.pop()
                stack.append([depth, i])
            v = link[t]
    return sorted((start, end - start + 1, d) for (start, end), d in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words after the first period of some run."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_tail(words: list[bytes], doc_id: int) -> list[bytes]:
    """The contract's planted repetition: in every tenth document by
    h = crc32(id) the words from place a on repeat with period p."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several word sequences."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in pieces(ids, doc):
        k = int(doc[a])
        shift = a - int(first[k])
        out[k] += [(start + shift, length, period) for start, length, period in find_runs(ids[a:b].tolist())]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def detect(docs: DataFrame, planted: bool = False, batch_words: int = 200_000) -> DataFrame:
    """``docs`` (doc_id, text, ...) with run_words (number of words), run_list
    (start, length, period of each run) and run_collapsed (the text without
    the repetitions, words joined by one space).  planted: first repeat the
    tail of every tenth document, see ``periodic_tail``.  Texts are taken in
    batches of about ``batch_words`` words; no shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(RUNS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows: list[tuple] = []
            held: list[list[bytes]] = []

            def flush():
                for words, runs in zip(held, batch_runs(held)):
                    kept = kept_words(len(words), runs)
                    left = words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k]
                    rows.append((len(words), [{"start": a, "length": b, "period": c} for a, b, c in runs], b" ".join(left).decode("utf-8", "replace")))
                held.clear()

            waiting = 0
            for i, t in zip(ids.tolist(), texts.tolist()):
                words = words_of(t)
                if planted and i is not None and i == i:
                    words = periodic_tail(words, int(i))
                held.append(words)
                waiting += len(words)
                if waiting >= batch_words:
                    flush()
                    waiting = 0
            flush()
            yield pd.DataFrame(rows, columns=["run_words", "run_list", "run_collapsed"])

    # ids travel as text: a column with nulls would reach pandas as floats
    made = run(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    row = docs.select(*[F.col(c) for c in docs.columns if c not in ("run_words", "run_list", "run_collapsed")], made.alias("run_made"))
    return row.select(*[c for c in row.columns if c != "run_made"], "run_made.run_words", "run_made.run_list", "run_made.run_collapsed")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the greatest one, digests."""
    runs = F.col("run_list")
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(order)
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"),
        F.floor(-best["l"] * 1000 / best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("run_collapsed").cast("binary"), 256).alias("collapsed_sha256"))
