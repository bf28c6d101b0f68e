"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Batches hold texts of about BATCH bytes together. A text longer than PIECE characters is cut before a space between two
characters that are no white space; no token of the split pattern, and no special string, goes across such a place, so
counts add up. Null and empty texts have no tokens.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, pieces, settled

BATCH, PIECE = 1 << 18, 1 << 14


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def split(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of at least `size` characters, cut at safe places only."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (text[cut - 1].isspace() or text[cut + 1:cut + 2].isspace() or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def counts(docs: DataFrame, path: str, columns: list[str], limit: int = 512) -> DataFrame:
    """The named columns with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path  a byte-level tokenizer file, readable on every worker
    """
    settled(docs.sparkSession)
    body = fresh(docs, "body_")
    base = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(body))
    schema = docs.select(*columns).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        tok = tokenizer(path)
        for part, _, offs in pieces(batches, body, BATCH):
            parts, owner = [], []
            for i, text in enumerate(part.column(body).to_pylist()):
                own = split(text)
                parts += own
                owner += [i] * len(own)
            n = np.zeros(part.num_rows, np.int64)
            at = 0
            while at < len(parts):  # one very long text is many batches
                to, size = at, 0
                while to < len(parts) and (to == at or size + len(parts[to]) <= BATCH):
                    size += len(parts[to])
                    to += 1
                np.add.at(n, owner[at:to], [len(e) for e in tok.encode_batch_fast(parts[at:to], add_special_tokens=False)])
                at = to
            yield pa.RecordBatch.from_pydict({**{f: part.column(f) for f in columns}, "n_bytes": pa.array(np.diff(offs)),
                                              "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return base.mapInArrow(run, schema)
