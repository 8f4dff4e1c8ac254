"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply lies under the loss mask.  Turns after the last
reply (or a conversation without one) become a closing example with an empty
mask, so no turn is lost.  Rows are dealt by conversation and sorted, and an
example is built as its target arrives: a task holds one conversation's
prefix at a time, never a group of rows.

The template writes a system turn as ``<<SYS>>..<</SYS>>``, a user turn as
``[INST]..[/INST]``, an assistant turn as ``<s>..</s>``, and any other role
(null as well) as ``<|role:name|>..<|end|>``.  Inside a text every control
string gets a backslash after its first character, and one that has
backslashes there already gets one more, so that unescaping is exact.

Handled: null texts (empty), null roles and turns, null conversation ids (one
conversation), repeated rows and tied turns (by turn, role, text), empty
tables, and further columns (ignored).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
_REST = r"(?:(?<=<)(\\*)(/?s>|</?SYS>>|\|role(?::[^|]*)?\|>|\|end\|>)|(?<=\[)(\\*)(/?INST\]))"
_CONTROL = re.compile(_REST)
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<\|role(?P<role>:[^|]*)?\|>(?P<other>.*?)<\|end\|>", re.S)
#: Characters of examples that a task gathers before it hands them on.
BATCH_CHARS = 4_000_000

EXAMPLES = "conv string, example long, text string, loss_start long, loss_end long, last boolean"
READ = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][1:], text)


def turn_parts(role: str | None, text: str) -> tuple[str, str, str]:
    """The opening mark, the escaped text and the closing mark of a turn."""
    if role in OPEN:
        return OPEN[role], escape(text), CLOSE[role]
    return "<|role|>" if role is None else f"<|role:{quote(role, safe='')}|>", escape(text), "<|end|>"


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of an example, unescaped."""
    out = []
    for m in _TURN.finditer(formatted):
        if m["other"] is not None:
            out.append((None if m["role"] is None else unquote(m["role"][1:]), unescape(m["other"])))
        else:
            kind = m.lastgroup
            out.append((kind, unescape(m[kind])))
    return out


def _some(value) -> str | None:
    return value if isinstance(value, str) else None


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    names = ["conv", "example", "text", "loss_start", "loss_end", "last"]
    current, prefix, n, length, pending = object(), [], 0, 0, None

    def close():
        """The example that ends a conversation."""
        if pending is not None:
            return [*pending, True]
        return [current, n, "".join(prefix), None, None, True] if prefix else None

    def frame():
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"example": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    for f in frames:
        for conv, role, text in zip(f["conv"].tolist(), f["role"].tolist(), f["text"].tolist()):
            conv, role, text = _some(conv), _some(role), _some(text) or ""
            if conv != current:
                if (done := close()) is not None:
                    rows.append(done)
                    held += len(done[2])
                current, prefix, n, length, pending = conv, [], 0, 0, None
            elif pending is not None:
                rows.append([*pending, False])
                held += len(pending[2])
                pending = None
            head, body, tail = turn_parts(role, text)
            prefix += [head, body, tail]
            if role == "assistant":
                prefix = ["".join(prefix)]
                pending = [current, n, prefix[0], length + len(head), length + len(head) + len(body)]
                n += 1
            length += len(head) + len(body) + len(tail)
            if held > BATCH_CHARS:
                yield frame()
                rows, held = [], 0
    if (done := close()) is not None:
        rows.append(done)
    if rows:
        yield frame()


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of every conversation: conv (its id as text), example
    (number from 0), text, the loss mask as a span of code points (null where
    nothing is trainable), and whether it is the conversation's last."""
    c = F.col
    rows = conversations.select(c("conv_id").cast("string").alias("conv"), c("turn"), c("role").cast("string"), c("text").cast("string"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return rows.select("conv", "role", "text").mapInPandas(_expand, EXAMPLES)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    loss, n_loss, chars = hashlib.sha256(), 0, 0
    for f in frames:
        rows = []
        for conv, example, text, a, b, last in zip(*(f[x].tolist() for x in ("conv", "example", "text", "loss_start", "loss_end", "last"))):
            chars += len(text)
            if a == a and a is not None:
                said = unescape(text[int(a) : int(b)])
                loss.update(said.encode("utf-8", "replace"))
                n_loss += len(said)
            if last:
                turns = parse(text)
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role or ''}\n{said}\n".encode("utf-8", "replace"))
                rows.append((_some(conv), len(turns), digest.hexdigest(), n_loss, loss.hexdigest(), chars, int(example) + 1))
                loss, n_loss, chars = hashlib.sha256(), 0, 0
        if rows:
            yield pd.DataFrame(rows, columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"])


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples of :func:`expand` say, per conversation:
    the turns are parsed from the text of its last example (which holds all),
    the trainable text from each example's mask.  The examples must come as
    ``expand`` makes them, together and in order within a partition."""
    return examples.mapInPandas(_read, READ)
