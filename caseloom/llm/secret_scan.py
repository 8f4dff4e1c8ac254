"""Secret scans through a trigram inverted index.

Each rule's regex is parsed, and a Boolean query over trigrams is derived
from the strings that any match must contain.  For every block of documents
an index maps each trigram that some rule asks for to its posting list; the
lists are united and intersected, and only the remaining documents are
verified with the regex.  A rule without a mandatory trigram scans them all.
An index covers one block, so nothing is shuffled and memory stays bounded
however large the corpus or a source is.

Letters are folded to lower case in the index (a superset of the matches of
either case), so the filter never loses a document.

Handled: null and empty texts (no spans), long texts, repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kind, regex, and the least length of the part that is judged (group 2 if
#: there is one, else the match).  The first three are the base kinds.
RULES: list[tuple[str, str, int]] = [
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    ("google", r"AIza[A-Za-z0-9_-]+", 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 16),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
]
BASE = ("assign", "access", "hex")
#: Bytes of text indexed together, and strings kept of one part of a regex.
BLOCK_BYTES, MOST_STRINGS = 4_000_000, 64
ALL = ("all",)


def _and(parts):
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts):
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(s: str):
    raw = s.encode().lower()
    return _and([("tri", raw[i : i + 3]) for i in range(len(raw) - 2)])


def _of_strings(strings: set[str]):
    return _or([_of_string(s) for s in sorted(strings)])


def _chars(items, flags: int) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg))
        elif op is K.RANGE and arg[1] - arg[0] < 8:
            out.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    # beyond ASCII a letter's other cases are not folded by the index
    if flags & re.I and not (flags & re.A and all(c.isascii() for c in out)):
        return None
    return out if len(out) <= 8 else None


def _walk(nodes, flags: int):
    """(query, strings): every match satisfies the query; strings is the set
    of all matches where that is known and small, else None."""
    parts, whole, tail = [], True, {""}

    def flush():
        nonlocal tail
        parts.append(_of_strings(tail))
        tail = {""}

    for op, arg in nodes:
        query, strings = ALL, None
        if op is K.LITERAL:
            strings = _chars([(op, arg)], flags)
        elif op is K.IN:
            strings = _chars(arg, flags)
        elif op is K.AT:
            strings = {""}
        elif op is K.SUBPATTERN:
            query, strings = _walk(arg[3], (flags | arg[1]) & ~arg[2])
        elif op is K.BRANCH:
            found = [_walk(b, flags) for b in arg[1]]
            query = _or([q for q, _ in found])
            if all(s is not None for _, s in found):
                strings = set().union(*(s for _, s in found))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, most, inner = arg
            q, s = _walk(inner, flags)
            if (least, most) == (0, 1):
                strings = {""} | s if s is not None else None
            elif least == most == 1:
                query, strings = q, s
            elif least >= 1:
                query = _and([q, ALL if s is None else _of_strings(s)])
        if strings is not None and len(strings) * len(tail) <= MOST_STRINGS:
            tail = {a + b for a in tail for b in strings}
            parts.append(query)
        else:
            flush()
            whole = False
            parts.append(_and([query, ALL if strings is None else _of_strings(strings)]))
    if whole:
        return _and(parts), tail
    flush()
    return _and(parts), None


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex: ("tri", bytes), ("and", ...),
    ("or", ...) or ALL."""
    tree = _parser.parse(pattern)
    query, strings = _walk(tree, tree.state.flags)
    return _and([query, ALL if strings is None else _of_strings(strings)])


def _trigrams(query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*(_trigrams(q) for q in query[1:])) if query != ALL else set()


class Scanner:
    """Compiled rules, their queries, and the table of indexed trigrams."""

    def __init__(self, rules=None):
        self.rules = [(k, re.compile(p), n, trigram_query(p)) for k, p, n in (RULES if rules is None else rules)]
        grams = sorted(set().union(*(_trigrams(q) for *_, q in self.rules)))
        self.gram = {g: i for i, g in enumerate(grams, 1)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for g, i in self.gram.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i

    def postings(self, texts: list[str]) -> dict[int, np.ndarray]:
        """Trigram number -> sorted positions of the texts that hold it."""
        raw = [t.encode("utf-8", "replace").lower() for t in texts]
        joined = np.frombuffer(b"\xff".join(raw) + b"\xff\xff\xff", dtype=np.uint8).astype(np.int32)
        found = self.table[joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]]
        at = np.flatnonzero(found)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(begins, at, side="right") - 1)
        gram, doc = pairs // len(texts), pairs % len(texts)
        cut = np.flatnonzero(np.diff(gram)) + 1
        return {int(g[0]): d for g, d in zip(np.split(gram, cut), np.split(doc, cut)) if len(g)}

    def candidates(self, query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query == ALL:
            return np.arange(n)
        if query[0] == "tri":
            return index.get(self.gram[query[1]], np.zeros(0, dtype=np.int64))
        lists = sorted((self.candidates(q, index, n) for q in query[1:]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The spans (start, end, kind number) of each text of a block, by
        start and then kind."""
        spans: list[list] = [[] for _ in texts]
        if not texts:
            return spans
        index = self.postings(texts)
        for number, (_, regex, least, query) in enumerate(self.rules):
            judged = 2 if regex.groups >= 2 else 0
            for d in self.candidates(query, index, len(texts)).tolist():
                spans[d] += [(m.start(), number, m.end()) for m in regex.finditer(texts[d]) if m.end(judged) - m.start(judged) >= least]
        return [[(a, b, k) for a, k, b in sorted(s)] for s in spans]


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    yield block


def spans_column(text: Column, rules=None) -> Column:
    """All spans of a text as an array of (kind, start, end), in code points,
    end exclusive, by start and then kind as listed."""
    kind = T.ArrayType(T.StringType())

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        names = [r[0] for r in scanner.rules]
        for s in batches:
            out = []
            for block in blocks(["" if t is None else t for t in s.tolist()]):
                out += [[f"{names[k]}:{a}:{b}" for a, b, k in x] for x in scanner.scan(block)]
            yield pd.Series(out, dtype=object)

    return F.transform(run(text.cast("string")), lambda x: F.struct(
        F.split_part(x, F.lit(":"), F.lit(1)).alias("kind"),
        F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("start"),
        F.split_part(x, F.lit(":"), F.lit(3)).cast("long").alias("end")))


def redacted_column(text: Column, mark: str = "[SECRET]", rules=None) -> Column:
    """The text with every maximal run of overlapping spans replaced by a
    mark; a null text stays null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for s in batches:
            texts, out = s.tolist(), []
            for block in blocks(["" if t is None else t for t in texts]):
                for t, spans in zip(block, scanner.scan(block)):
                    parts, end = [], 0
                    for a, b, _ in spans:
                        if a >= end:
                            parts += [t[end:a], mark]
                        end = max(end, b)
                    out.append("".join(parts) + t[end:] if spans else t)
            yield pd.Series([None if t is None else o for t, o in zip(texts, out)], dtype=object)

    return run(text.cast("string"))


def scan(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """``docs`` with the column ``secret_spans`` appended."""
    return docs.withColumn("secret_spans", spans_column(F.col(text), rules))
