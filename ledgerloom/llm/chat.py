"""Chat formatting with offset-aligned loss masks.

A turn is written as `<|im_start|>role<|im_sep|>text<|im_end|>` and a line end. Inside roles and texts every `<|`, with
any backslashes between its two characters, gets one backslash more, so no control string can arise there and the way back
is exact. Conversations are laid out in turn order over range partitions and rendered in parts that end between turns:
the parts of a conversation, in order, are its whole text, and a conversation of any length is never held by one task.

A part is encoded once with offsets; the control strings are added tokens, so no token crosses a text's border. Tokens are
put under the loss by binary search of their starts among the sorted spans of the turns.

Null texts and roles are empty; turns without a number come first; equal numbers follow role and text. Rows without a
conversation id form one conversation.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import NO_ID, settled

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters after which a part ends.
PART = 1 << 15
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, normalized=False) for x in (START, SEP, END)])
    return t


def masked(spans: np.ndarray, loss: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which tokens (start, end) lie in a text under the loss; spans are sorted and disjoint."""
    at = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    inside = (at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 0] < spans[at, 1])
    return inside & loss[at]


def format_parts(turns: DataFrame, path: str, train_on: str = "assistant") -> DataFrame:
    """conv_id, at, seq (order of the parts), formatted, ids, offsets (start, end per token), loss (one boolean per token).

    turns  conv_id, turn, role, text
    path   a tokenizer file, readable on every worker
    """
    settled(turns.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
                        empty("role"), empty("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, at long, seq long, formatted string, ids array<int>, offsets array<int>, loss array<boolean>"

    def render(batches):
        tok, seq = tokenizer(path), 0
        conv, at, text, spans, loss, size = None, None, [], [], [], 0

        def part():
            nonlocal seq
            whole = "".join(text)
            got = tok.encode(whole, add_special_tokens=False)
            offs = np.array(got.offsets, np.int32).reshape(-1, 2)
            mask = masked(np.array(spans), np.array(loss), offs)
            seq += 1
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([conv], pa.int64()), "at": pa.array([at], pa.int64()), "seq": pa.array([seq], pa.int64()), "formatted": [whole],
                "ids": pa.array([got.ids], pa.list_(pa.int32())), "offsets": pa.array([offs.ravel()], pa.list_(pa.int32())),
                "loss": pa.array([mask], pa.list_(pa.bool_()))})

        for batch in batches:
            for c, turn, role, body in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text"))):
                if text and (c != conv or size >= PART):
                    yield part()
                    text, spans, loss, size = [], [], [], 0
                if not text:
                    conv, at = c, turn
                head = START + escape(role) + SEP
                body = escape(body)
                spans.append((size + len(head), size + len(head) + len(body)))
                loss.append(role == train_on)
                text.append(head + body + END + "\n")
                size += len(text[-1])
        if text:
            yield part()

    return rows.mapInArrow(render, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from the parts alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests run over the parts in order; only one part is in memory.
    """
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "at", "seq")
    turn = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)

    def read(batches):
        conv, open_, n, chars, formatted, turns, under = None, False, 0, 0, 0, sha256(), sha256()
        cols = ("conv_id", "formatted", "offsets", "loss")

        def row():
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([conv], pa.int64()), "n_turns": pa.array([n], pa.int64()), "turns_sha256": [turns.hexdigest()],
                "loss_chars": pa.array([chars], pa.int64()), "loss_sha256": [under.hexdigest()], "formatted_chars": pa.array([formatted], pa.int64())})

        for batch in batches:
            for c, whole, offs, loss in zip(*(batch.column(k).to_pylist() for k in cols)):
                if open_ and c != conv:
                    yield row()
                    n, chars, formatted, turns, under = 0, 0, 0, sha256(), sha256()
                conv, open_ = c, True
                formatted += len(whole)
                for m in turn.finditer(whole):
                    n += 1
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                offs, loss = np.array(offs, np.int64).reshape(-1, 2), np.array(loss, bool)
                on = offs[loss]
                # Tokens of a text follow each other without a gap, or share a character; control tokens part the texts.
                new = np.ones(len(on), bool)
                new[1:] = on[1:, 0] > np.maximum.accumulate(on[:, 1])[:-1] if len(on) else new[1:]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(on)) - 1
                for a, b in zip(on[first, 0].tolist(), on[last, 1].tolist()) if len(on) else ():
                    said = unescape(whole[a:b])
                    chars += len(said)
                    under.update(said.encode())
        if open_:
            yield row()

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
