"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words (white space marker plus what follows) of a block of texts are
laid out once each as one flat array of symbol ids.  A round looks up the
rank of every adjacent pair inside a word, takes the smallest rank of each
word (a segmented minimum), merges all its occurrences from left to right,
and compacts the array; rounds go on until no word has a known pair.  Merging
several occurrences at once is exact unless a merge creates a pair that
ranks no worse than the current one; such a word merges up to that place
only, so every step is one that the library's agenda would make.

Runs of bare markers rank last in the vocabulary and tie among themselves;
they are joined after the rounds, left to right.

Handled: null and empty texts (the end id only), texts of any length, bytes
of characters outside the vocabulary, repeated rows; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import small_batches

MARK = "▁"
#: Words encoded in one go; texts split into words at once; cached encodings
#: of words per task, in bytes of their strings and entries.
BLOCK_WORDS, SPLIT_CHARS, CACHE_BYTES = 20_000, 4_000_000, 32_000_000
#: Bytes of a cached word beside its characters: two strings and a dict entry.
ENTRY_BYTES = 200
OUT = T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def load_vocabulary(model_path: str) -> dict:
    """Pieces, scores and id classes of a BPE model file with byte fallback
    and the identity normaliser."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = len(m)
    return {
        "pieces": [m.id_to_piece(i) for i in range(n)], "scores": [m.get_score(i) for i in range(n)],
        "special": [i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)],
        "bytes": [i for i in range(n) if m.is_byte(i)], "eos": m.eos_id(),
    }


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: dict):
        pieces, scores = vocabulary["pieces"], vocabulary["scores"]
        skip = set(vocabulary["special"]) | set(vocabulary["bytes"])
        self.eos, self.size = vocabulary["eos"], len(pieces)
        self.id_of = {p: i for i, p in enumerate(pieces) if i not in skip}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i in vocabulary["bytes"]:
            self.byte_id[int(pieces[i][3:5], 16)] = i
        self.mark = self.id_of[MARK]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        #: Symbols past the vocabulary stand for the bytes of an unknown character; none merges.
        self.byte_base = self.size
        keys, values = [], []
        for p, i in self.id_of.items():
            if len(p) > 1 and set(p) != {MARK}:
                for k in range(1, len(p)):
                    a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                    if a is not None and b is not None:
                        keys.append(a * self.size + b)
                        values.append((order[scores[i]] << 20) | i)
        self.none = np.int64(1) << 60
        self._build(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int64))
        surface = [p.replace(MARK, " ").encode() for p in pieces]
        for i in vocabulary["special"]:
            surface[i] = b""
        for i in vocabulary["bytes"]:
            surface[i] = bytes([int(pieces[i][3:5], 16)])
        self.surface = surface
        self.char_id = np.full(0x110000, self.byte_base, dtype=np.int64)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.digits = [*map(str, range(self.size)), "|"]
        #: Of each word seen: its ids as decimal text; its decoded text where that is not the word itself.
        self.shown: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.runs: dict[int, list[int]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 21)).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table; ``probes`` is its longest chain."""
        self.keys = np.full((1 << 21) + 64, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full((1 << 21) + 64, self.none, dtype=np.int64)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            at = slot[left] + self.probes
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, one = np.unique(at, return_index=True)
            take = np.zeros(len(left), dtype=bool)
            take[one] = True
            take &= free
            self.keys[at[take]], self.values[at[take]] = keys[left[take]], values[left[take]]
            left, self.probes = left[~take], self.probes + 1
        assert self.probes <= 64

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, or ``none``."""
        out = np.full(len(a), self.none, dtype=np.int64)
        known = np.flatnonzero((a < self.size) & (b < self.size) & (a >= 0) & (b >= 0))
        key = a[known].astype(np.uint64) * np.uint64(self.size) + b[known].astype(np.uint64)
        slot = self._slot(key)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key
            out[known[hit]] = self.values[slot[hit]]
            go = ~hit & (found != np.iinfo(np.uint64).max)
            known, key, slot = known[go], key[go], slot[go] + 1
            if not len(known):
                break
        return out

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left.  word: ascending word number of each
        symbol.  Words without a pair leave the working arrays."""
        done_s, done_w = [], []
        none = self.none
        while len(sym):
            pair = np.full(len(sym), none, dtype=np.int64)
            same = np.flatnonzero(word[:-1] == word[1:])
            pair[same] = self.rank(sym[same], sym[same + 1])
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(pair, start)
            length = np.diff(np.append(start, len(sym)))
            live = np.repeat(least < none, length)
            if not live.all():
                done_s.append(sym[~live])
                done_w.append(word[~live])
                sym, word, pair, least = sym[live], word[live], pair[live], np.repeat(least, length)[live]
                if not len(sym):
                    break
            else:
                least = np.repeat(least, length)
            # the same rank may come from two splits of one piece; all are candidates
            hit = np.flatnonzero(pair == least)
            # leftmost merges: in a chain of overlapping hits every other one counts
            head = np.concatenate([[True], np.diff(hit) > 1])
            place = np.arange(len(hit))
            place -= np.maximum.accumulate(np.where(head, place, 0))
            hit = hit[place % 2 == 0]
            merged = pair[hit] & ((1 << 20) - 1)
            # pairs that each merge creates, seen at its time: the left side has been merged, the right side has not
            w, r = word[hit], pair[hit] >> 20
            before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
            joined = np.concatenate([[False], (np.diff(hit) == 2) & (np.diff(w) == 0)])
            left = np.where(joined, np.concatenate([[0], merged[:-1]]), sym[before])
            has_l, has_r = (hit > 0) & (word[before] == w), (hit + 2 < len(sym)) & (word[after] == w)
            new = np.minimum(np.where(has_l, self.rank(left, merged), none) >> 20, np.where(has_r, self.rank(merged, sym[after]), none) >> 20)
            bad = new <= r
            if bad.any():
                # up to the first such merge of its word, that one included
                first = np.concatenate([[True], w[1:] != w[:-1]])
                earlier = np.cumsum(bad) - bad
                keep = earlier == np.maximum.accumulate(np.where(first, earlier, 0))
                hit, merged = hit[keep], merged[keep]
            sym = sym.copy()
            sym[hit] = merged
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        if not done_s:
            return sym, word
        sym, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words (marker first), and the word of each; the
        characters outside the vocabulary come as bytes."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sym = self.char_id[points]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        if (sym >= self.byte_base).any():
            kinds = np.unique(points[sym >= self.byte_base])
            coded = [chr(c).encode() for c in kinds.tolist()]
            matrix = np.zeros((len(kinds), 4), dtype=np.int64)
            for i, x in enumerate(coded):
                matrix[i, : len(x)] = self.byte_base + np.frombuffer(x, dtype=np.uint8).astype(np.int64)
            which = np.minimum(np.searchsorted(kinds, points), len(kinds) - 1)
            unknown = sym >= self.byte_base
            width = np.where(unknown, np.array([len(x) for x in coded])[which], 1)
            position = np.repeat(np.arange(len(sym)), width)
            into = np.arange(len(position)) - np.repeat(np.cumsum(width) - width, width)
            sym = np.where(unknown[position], matrix[which[position], into], sym[position])
            word = word[position]
        sym, word = self.merge_rounds(sym, word)
        raw = np.flatnonzero(sym >= self.byte_base)
        sym[raw] = self.byte_id[sym[raw] - self.byte_base]
        return sym, word

    def join_marks(self, n: int) -> list[int]:
        """A run of n bare markers, joined leftmost pair first."""
        if n not in self.runs:
            size: list[int] = []
            for i in range(n):
                size.append(1)
                while len(size) > 1 and MARK * (size[-1] + size[-2]) in self.id_of:
                    size[-2:] = [size[-2] + size[-1]]
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = [self.id_of[MARK * k] for k in size]
        return self.runs[n]

    #: Bytes that the cached words take.
    held = 0

    def learn(self, words: set[str]) -> None:
        """Encode the words not seen so far, in blocks."""
        new = list(words - self.shown.keys())
        if self.held + sum(map(len, new)) + ENTRY_BYTES * len(new) > CACHE_BYTES:
            self.shown.clear()
            self.odd.clear()
            self.held, new = 0, list(words)
        at = 0
        while at < len(new):
            upto, chars = at, 0
            while upto < len(new) and upto - at < BLOCK_WORDS and chars < 2_000_000:
                chars += len(new[upto]) + 1
                upto += 1
            block = new[at:upto]
            sym, word = self.encode_words([MARK + w for w in block])
            # every word begins with the marker and holds no other: texts and id lists split apart again
            self.odd.update((w, said) for w, said in zip(block, self.decode_raw(sym.tolist()).split(" ")[1:]) if w != said)
            ends = np.flatnonzero(word[1:] != word[:-1]) + 1
            shown = " ".join(map(self.digits.__getitem__, np.insert(sym, ends, self.size).tolist()))
            self.shown.update(zip(block, shown.split(" | ")))
            self.held += chars + len(shown) + ENTRY_BYTES * len(block)
            at = upto

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, the end id last."""
        words = text.replace(MARK, " ").split(" ") if text else []
        self.learn(set(words))
        return np.array(self._ids(words), dtype=np.int32)

    def _ids(self, words: list[str]) -> list[int]:
        out: list[int] = []
        run = 0
        for w in words:
            if w == "":
                run += 1
                continue
            ids = list(map(int, self.shown[w].split(" ")))
            if run:
                bare = ids[0] == self.mark
                out += self.join_marks(run + bare)
                ids = ids[bare:]
            out += ids
            run = 0
        if run:
            out += self.join_marks(run)
        return [*out, self.eos]

    def decode_raw(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, markers as
        spaces, the first space (of the added marker) taken off."""
        out = self.decode_raw([int(i) for i in ids])
        return out[1:] if out.startswith(" ") else out


def encode_texts(texts: list[str], codec: Codec, ids_too: bool, text_too: bool) -> pd.DataFrame:
    """The columns of ``OUT`` for a batch; ids and decoded text where asked."""
    rows = []
    at = 0
    while at < len(texts):
        todo: set[str] = set()
        split, upto, chars = [], at, 0
        while upto < len(texts) and chars < SPLIT_CHARS and ENTRY_BYTES * len(todo) < CACHE_BYTES // 2:
            split.append(texts[upto].replace(MARK, " ").split(" ") if texts[upto] else [])
            todo.update(split[-1])
            chars += len(texts[upto])
            upto += 1
        codec.learn(todo)
        for words in split:
            if "" in words:
                ids = codec._ids(words)
                shown, text = " ".join(map(str, ids)), codec.decode(ids)
            else:
                shown = " ".join([*map(codec.shown.__getitem__, words), codec.digits[codec.eos]])
                text = " ".join(words if codec.odd.keys().isdisjoint(words) else [codec.odd.get(w, w) for w in words])
                ids = list(map(int, shown.split(" "))) if ids_too else None
            rows.append((
                np.array(ids, dtype="<i4").tobytes() if ids_too else None, shown.count(" ") + 1,
                hashlib.sha256(shown.encode()).hexdigest(), text if text_too else None,
                hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
            ))
        at = upto
    return pd.DataFrame(rows, columns=OUT.names)


def encode_column(spark, text: Column, model_path: str, ids: bool = True, decoded: bool = True) -> Column:
    """A struct of ids (int32, little endian), n_tokens, ids_sha256, decoded
    and decoded_sha256 for a text column; ids and decoded are null where they
    are not asked for.  The vocabulary (below 1 MB) travels as a broadcast."""
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(model_path))

    @F.pandas_udf(OUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary.value)
        for s in batches:
            yield encode_texts(["" if t is None else t for t in s.tolist()], codec, ids, decoded)

    return run(text)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """``docs`` with the columns of :func:`encode_column` appended as one
    struct ``sp_encoded`` (so no column name of ``docs`` clashes with its
    parts)."""
    return docs.withColumn("sp_encoded", encode_column(docs.sparkSession, F.col(text).cast("string"), model_path, ids, decoded))
