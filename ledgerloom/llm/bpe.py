"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut by the split pattern. A piece that is a vocabulary entry is resolved by a minimal perfect hash (hash and
displace: one slot per entry, one displacement per bucket of entries, the stored entry compared for exactness). Any other
piece is merged over linked bytes: a heap holds the ranks of neighbouring parts, and the lowest rank, leftmost first, is
merged until none is left. Pieces met before are remembered per worker in two generations of bounded size.

Encoding reads whole texts; those over `LONG` characters are walked match by match with running digests, so that the list
of their pieces is never whole in memory. Null counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import GOLD, factors, fresh, mix, pieces, settled

#: Characters from which a text is walked in parts of STRIDE pieces.
LONG, STRIDE = 1 << 18, 1 << 15
#: Pieces of one generation of a worker's memory.
KEPT = 100_000


def hashes(parts: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64) + np.uint64(1)
    pos = np.arange(len(data)) - np.repeat(first, lens)
    return mix(np.add.reduceat(data * factors(int(lens.max()))[pos], first) + lens.astype(np.uint64) * GOLD)


class PerfectHash:
    """Minimal perfect hash of byte strings: as many slots as entries."""

    def __init__(self, entries: list[bytes], per_bucket: int = 4, tries: int = 64):
        n = self.n = len(entries)
        h = hashes(entries)
        if len(np.unique(h)) < n:
            raise ValueError("two entries share a hash")
        buckets = self.buckets = max(1, n // per_bucket)
        home = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        size = np.bincount(home, minlength=buckets)
        at = np.concatenate(([0], np.cumsum(size)))
        self.shift = np.zeros(buckets, np.int64)
        slot_of = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-size, kind="stable"):
            own = order[at[b]:at[b + 1]]
            if len(own) < 2:
                break
            base = 1
            while True:
                shift = np.arange(base, base + tries, dtype=np.uint64)[:, None]
                slot = (mix(h[own] + shift * GOLD) % np.uint64(n)).astype(np.int64)
                sure = free[slot].all(1)
                sure &= (np.diff(np.sort(slot, 1), axis=1) > 0).all(1)
                if sure.any():
                    hit = int(np.argmax(sure))
                    break
                base += tries
            self.shift[b] = base + hit
            slot_of[own] = slot[hit]
            free[slot[hit]] = False
        left = np.flatnonzero(free)[::-1].tolist()
        for b in np.flatnonzero(size == 1):  # a bucket of one names its slot
            s = left.pop()
            self.shift[b] = -1 - s
            slot_of[order[at[b]]] = s
        self.entry = np.argsort(slot_of)

    def slots(self, parts: list[bytes]) -> np.ndarray:
        """The entry number that each string would have; the caller compares."""
        h = hashes(parts)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = (mix(h + shift.astype(np.uint64) * GOLD) % np.uint64(self.n)).astype(np.int64)
        return self.entry[np.where(shift < 0, -1 - shift, slot)]


@lru_cache(maxsize=4)
def vocabulary(path: str):
    """Entries of a rank file as (tokens by id, perfect hash)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens, PerfectHash([t for t in tokens if t])


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str):
        self.tokens, self.table = tokens, table
        self.present = [i for i, t in enumerate(tokens) if t]
        self.entries = [tokens[i] for i in self.present]
        self.ranks = {t: i for i, t in zip(self.present, self.entries)}
        self.size = [len(t) for t in tokens]
        self.decimal = [str(i) for i in range(len(tokens))]
        self.cut = regex.compile(pattern)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece by merging: a heap of ranks over linked bytes."""
        n, get, size = len(piece), self.ranks.get, self.size
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << 32 | i for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            low = heappop(heap)
            i = low & 0xFFFFFFFF
            e = i + size[low >> 32]
            j = end[i]
            if j < 0 or j >= e or end[j] != e:
                continue  # one of the parts has been merged since
            end[i], end[j] = e, -1
            if e < n:
                before[e] = i
                if (r := get(piece[i:end[e]])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := get(piece[p:e])) is not None:
                heappush(heap, r << 32 | p)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(ids)

    def learn(self, pieces: set[str]) -> None:
        """Make sure that all pieces are in the young generation."""
        young, old = self.young, self.old
        new = []
        for p in pieces:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        if new:
            raw = [p.encode() for p in new]
            for p, b, at in zip(new, raw, self.table.slots(raw).tolist()):
                young[p] = (self.present[at],) if self.entries[at] == b else self.merged(b)

    def turn(self) -> None:
        """Between texts: once the young generation is full it becomes the old one."""
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young

    def encode(self, text: str):
        """Ids in lists: one for a text of usual length, several for a long one."""
        if len(text) <= LONG:
            found = self.cut.findall(text)
            self.learn(set(found))
            yield list(chain.from_iterable(map(self.young.__getitem__, found)))
            self.turn()
            return
        walk = self.cut.finditer(text)
        while found := [m[0] for m in islice(walk, STRIDE)]:
            self.learn(set(found))
            yield list(chain.from_iterable(map(self.young.__getitem__, found)))
            self.turn()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}


def codec(key: tuple, parts) -> Codec:
    """The worker's codec of a vocabulary: built once, kept between tasks."""
    if key not in _CODECS:
        _CODECS[key] = Codec(*parts.value, key[1])
    return _CODECS[key]


def encode(docs: DataFrame, ranks: str, pattern: str, columns: list[str], ids: bool = True, digests: bool = False) -> DataFrame:
    """The named columns with `ids` (array<int>), or with n_tokens, ids_sha256 and decoded_sha256 of ids and decoding.

    ranks    path of a rank file, read by the driver
    pattern  the split pattern
    """
    spark = settled(docs.sparkSession)
    key, sent = (ranks, pattern), spark.sparkContext.broadcast(vocabulary(ranks))
    body = fresh(docs, "body_")
    base = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(body))
    schema = docs.select(*columns).schema
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if digests:
        schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        c = codec(key, sent)
        for part, _, _ in pieces(batches, body):
            lists, count, of_ids, of_bytes = [], [], [], []
            for text in part.column(body).to_pylist():
                a, b, n, whole = sha256(), sha256(), 0, []
                for some in c.encode(text):
                    if digests:
                        if some:
                            a.update((("," if n else "") + ",".join(map(c.decimal.__getitem__, some))).encode())
                        b.update(c.decode(some))
                    if ids:
                        whole.append(np.array(some, np.int32))
                    n += len(some)
                count.append(n)
                of_ids.append(a.hexdigest())
                of_bytes.append(b.hexdigest())
                if ids:
                    lists.append(np.concatenate(whole) if whole else np.empty(0, np.int32))
            out = {f: part.column(f) for f in columns}
            if ids:
                out["ids"] = pa.array(lists, pa.list_(pa.int32()))
            if digests:
                out |= {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_bytes}
            yield pa.RecordBatch.from_pydict(out)

    return base.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: str, columns: list[str]) -> DataFrame:
    """The named columns with `bytes`: the texts of column `ids`. A null list decodes to no bytes."""
    sent = settled(rows.sparkSession).sparkContext.broadcast(vocabulary(ranks)[0])
    schema = rows.select(*columns).schema.add("bytes", "binary")

    def run(batches):
        tokens = sent.value
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, x or ())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({**{f: batch.column(f) for f in columns}, "bytes": pa.array(texts, pa.binary())})

    return rows.select(*columns, "ids").mapInArrow(run, schema)
