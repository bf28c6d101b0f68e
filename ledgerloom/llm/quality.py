"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed features: its words, and the shapes of its words (runs of lower and upper case, digits and
each mark, plus whether the word repeats the one before). Counts enter by their logarithm times the feature's inverse
document frequency in the labelled sample, each block has unit length. The sample's leading singular vectors span the
latent space. Labelled vectors are broadcast; every text is compared with all of them by exact cosine products in blocks,
and its NEAREST neighbours vote with a power of their similarity.

The sample holds at most PER_CLASS labelled texts per class, chosen by the hash of their id, each of at most LONGEST bytes,
which bounds the broadcast (2 * PER_CLASS * RANK floats and the projection). Scoring reads every text whole.

Texts without words score 0. Without labels every text scores 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import GOLD, factors, fresh, mix, pieces, settled, word_hashes

WORDS, SHAPES, RANK, NEAREST, POWER = 1536, 512, 48, 15, 6
PER_CLASS, LONGEST = 1500, 1 << 14

_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


def shape_hashes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hash of every word's shape, in the order of `word_hashes`."""
    kind = _KIND[data]
    white = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = ~white
    start[1:] &= white[:-1] | edge[1:-1]
    keep = ~white
    keep[1:] &= (kind[1:] != kind[:-1]) | start[1:]
    at = np.flatnonzero(keep)
    first = np.flatnonzero(start[at])
    if not len(first):
        return np.empty(0, np.uint64)
    pos = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return mix(np.add.reduceat((kind[at].astype(np.uint64) + np.uint64(1)) * factors(int(pos.max()) + 1)[pos], first))


def counted(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Feature counts, one row per text."""
    n, width = len(offs) - 1, WORDS + SHAPES
    h, doc = word_hashes(data, offs)
    shape = (shape_hashes(data, offs) % np.uint64(SHAPES - 1)).astype(np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    slot = np.concatenate([(h % np.uint64(WORDS)).astype(np.int64), WORDS + shape, np.full(again.sum(), width - 1)])
    row = np.concatenate([doc, doc, doc[again]])
    return np.bincount(row * width + slot, minlength=n * width).reshape(n, width).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    return np.concatenate([0.5 * unit(x[:, :WORDS]), unit(x[:, WORDS:])], 1)


class Voters:
    """Labelled vectors of the sample, the projection that made them, and the labels."""

    def __init__(self, texts: list[str], labels):
        data = [t.encode() for t in texts]
        count = np.concatenate([counted(*_joined(data[i:i + 200])) for i in range(0, len(data), 200)])
        self.idf = np.log((1 + len(count)) / (1 + (count > 0).sum(0))).astype(np.float32) + 1
        x = weighted(count, self.idf)
        _, axes = np.linalg.eigh(x.T @ x)
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :RANK], np.float32)
        self.vectors = np.ascontiguousarray(unit(x @ self.axes).T, np.float32)
        self.labels = np.asarray(labels, np.float32)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offs) - 1)
        for a in range(0, len(out), 256):
            o = offs[a:a + 257]
            count = counted(data[o[0]:o[-1]], o - o[0])
            near = unit(weighted(count, self.idf) @ self.axes) @ self.vectors
            k = min(NEAREST, near.shape[1])
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(near, top, 1), 1e-6) ** POWER
            out[a:a + 256] = np.where(count.any(1), (vote * self.labels[top]).sum(1) / vote.sum(1), 0)
        return np.clip(out, 0, 1)


def _joined(parts: list[bytes]):
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def held_out(id):
    """Documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Voters | None:
    """Vectors of a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where(~held_out(F.col("doc_id"))).where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    picked = None
    for c in (0, 1):
        one = known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= LONGEST)
            .join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).collect())
    return Voters([r["text"] for r in rows], [r["y"] for r in rows]) if rows else None


def scores(docs: DataFrame, voters: Voters | None, columns: list[str]) -> DataFrame:
    """The named columns of the documents with `score`."""
    sent = settled(docs.sparkSession).sparkContext.broadcast(voters)
    body = fresh(docs, "body_")
    base = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(body))

    def run(batches):
        v = sent.value
        for part, data, offs in pieces(batches, body):
            got = v.score(data, offs) if v is not None else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_pydict({**{f: part.column(f) for f in columns}, "score": pa.array(got)})

    return base.mapInArrow(run, docs.select(*columns).schema.add("score", "double"))
