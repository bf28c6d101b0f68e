"""Ranked lexical search of items over all documents, term at a time with limited accumulators.

Terms are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z as a-z. A first pass writes the
postings of every document for the terms that the items hold; counts over it give each term's weight
floor(1000 * ln((2N + 2) / (2 df + 1))). A second pass reads the postings in shards. In a shard every item takes its terms
rarest first; each one adds to the accumulators of its documents. Once the most that the terms left could give
lies below the k-th partial score (of the shard, or of what the task holds from earlier shards), no document without an
accumulator can reach the first k, so none is created any more: the terms left update the survivors only, exactly, and those
that can't reach the k-th score go. Each task passes on k documents an item; two levels of windows merge them.

Scores are integers: w * ((10^9 tf) div (1000 tf + k1 m)) summed over the item's terms, repeats included, with
m = 100 - b + (b n N) div L. Equal scores rank by ascending doc_id, null last; rows that repeat a doc_id are documents of
their own. Null and empty texts have no terms; without any term in the documents, or in an item, there are no rows.
Items are searched once per distinct text, in blocks of BLOCK bytes of item text, each a pass over the documents; an item_id
that repeats, or is null, gets the rows of each of its texts. A long text is cut at separators and read whole.

Memory of a task: one shard (POSTINGS postings or DOCS documents, or one document) and k documents an item of the block.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import byte_bound, cut

BLOCK, POSTINGS, DOCS, CHUNK = 4 << 20, 2_000_000, 1 << 16, 1 << 20
SALTS = 64
#: Bytes of terms stay (A-Z as a-z), all others part them.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        to = len(text) if len(text) - at <= CHUNK else text.find(b" ", at + CHUNK)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def term_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for some in terms(text):
        found.update(some)
    return found


def postings(docs: DataFrame, known, text: str, id: str) -> DataFrame:
    """doc_id, n (terms with repeats), and of the known terms their numbers and occurrences; documents with a term only."""
    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            n, ids, tfs = [], [], []
            for body in batch.column(1).cast(pa.large_binary()).to_pylist():
                found = term_counts(body)
                n.append(found.total())
                here = [(number[t], c) for t, c in found.items() if t in number]
                ids.append([x[0] for x in here])
                tfs.append([x[1] for x in here])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                                   pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    body = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return body.mapInArrow(indexed, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


class Shard:
    """Postings of some documents, by term."""

    def __init__(self, ids: list, n: list[int], term: np.ndarray, tf: np.ndarray, per_doc: np.ndarray, total: tuple, k1: int, b: int):
        N, L = total
        self.ids, self.size = ids, len(ids)
        doc = np.repeat(np.arange(self.size, dtype=np.int32), per_doc)
        m = np.array([100 - b + b * x * N // L for x in n], np.int64)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        tf = tf[order]
        self.gain = 1_000_000_000 * tf // (1000 * tf + k1 * m[self.doc])
        held, first = np.unique(term[order], return_index=True)
        most = np.maximum.reduceat(self.gain, first) if len(first) else first
        edge = [*first.tolist(), len(term)]
        self.at = {t: (a, z, g) for t, a, z, g in zip(held.tolist(), edge, edge[1:], most.tolist())}
        self.acc = np.zeros(self.size, np.int64)

    def best(self, item: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold the shard's first k of an item (ties with the k-th too), none below `floor`.

        `item` has (term, weight times repeats), rarest first; `floor` is a score that k documents elsewhere reach.
        """
        here = [(w, *self.at[t]) for t, w in item if t in self.at]
        left = np.cumsum([w * g for w, _, _, g in here][::-1])[::-1].tolist() + [0]
        acc, bound = self.acc, floor
        acc[:] = 0
        alive = None
        for i, (w, a, z, _) in enumerate(here):
            if alive is None and left[i] < max(bound, int(acc.max())):
                some = acc[acc > 0]
                if len(some) >= k:
                    bound = max(bound, int(np.partition(some, -k)[-k]))
                if left[i] < bound:
                    alive = np.flatnonzero(acc + left[i] >= bound)
                    alive = alive[acc[alive] > 0]
            docs, gain = self.doc[a:z], self.gain[a:z]
            if alive is None:
                acc[docs] += w * gain
                continue
            if not len(alive):
                break
            at = np.searchsorted(docs, alive)
            at[at == len(docs)] = 0
            hit = docs[at] == alive
            acc[alive[hit]] += w * gain[at[hit]]
            if len(alive) > k:
                bound = max(bound, int(np.partition(acc[alive], -k)[-k]))
                alive = alive[acc[alive] + left[i + 1] >= bound]
        found = np.flatnonzero(acc) if alive is None else alive[acc[alive] > 0]
        if len(found) > k:
            bound = max(bound, int(np.partition(acc[found], -k)[-k]))
        found = found[acc[found] >= max(bound, 1)]
        return found, acc[found]


def ranked(index: DataFrame, items, total: tuple, k: int, k1: int, b: int) -> DataFrame:
    """Of every partition the first k documents of each item (its number in the list): item, doc_id, score."""
    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        top: list[list[tuple]] = [[] for _ in asked]  # (-score, null id last, id), sorted, at most k
        for shard in shards(batches, total, k1, b):
            for held, item in zip(top, asked):
                docs, scores = shard.best(item, k, -held[-1][0] if len(held) >= k else 0)
                if len(docs):
                    held += [(-s, (i := shard.ids[d]) is None, i or 0) for d, s in zip(docs.tolist(), scores.tolist())]
                    held.sort()
                    del held[k:]
        rows = [(q, None if none else i, -s) for q, held in enumerate(top) for s, none, i in held]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[], [], []], [pa.int32(), pa.int64(), pa.int64()])],
                              ["item", "doc_id", "score"])
    return index.mapInArrow(searched, "item int, doc_id long, score long")


def shards(batches: Iterable[pa.RecordBatch], total: tuple, k1: int, b: int) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []
    docs = size = 0

    def made() -> Shard:
        whole = pa.Table.from_batches(held).combine_chunks()
        terms, tfs = (whole.column(c).combine_chunks() for c in ("terms", "tfs"))
        return Shard(whole.column("doc_id").to_pylist(), whole.column("n").to_pylist(), terms.flatten().to_numpy(),
                     tfs.flatten().to_numpy(), np.diff(terms.offsets.to_numpy()), total, k1, b)
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        docs, size = docs + batch.num_rows, size + len(batch.column(2).flatten())
        if docs >= DOCS or size >= POSTINGS:
            yield made()
            held, docs, size = [], 0, 0
    if held:
        yield made()


def search(docs: DataFrame, items: DataFrame, k: int = 20, k1: int = 12, b: int = 25, text: str = "text", id: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id", block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest score above 0, k1 in tenths, b in hundredths."""
    spark = byte_bound(docs.sparkSession)
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    asked = asked.withColumn("key", F.sha2("text", 256))
    texts = cut(asked.select("key", "text").distinct(), "items")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    parts = []
    for at in range(blocks):
        here = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == at).collect()
        found = [(r["key"], term_counts(r["text"].encode())) for r in here]
        known = {t: i for i, t in enumerate(dict.fromkeys(t for _, c in found for t in c))}
        index = cut(postings(docs, spark.sparkContext.broadcast(known), text, id), "postings")
        N, L = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * c + 1))) for t, c in df.items()}
        wanted = [sorted(((known[t], q * weight[known[t]]) for t, q in c.items() if weight.get(known[t])),
                         key=lambda x: (df[x[0]], x[0])) for _, c in found]
        hits = ranked(index, spark.sparkContext.broadcast(wanted), (N, L), k, k1, b)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(found)], "item int, key string")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        parts.append(last.join(names, "item").select("key", "rank", "doc_id", "score"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return asked.drop("text").join(whole, "key").select("item_id", "rank", "doc_id", "score")
