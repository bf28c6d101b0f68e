"""Token ids in files: canonical length-limited Huffman codes from global counts, decoded by tables.

Folder layout (Parquet): `code` has the length of each id's code; `documents` has one row per document in ascending id
order (range partitions, each a shard whose rows are sorted), with the bits of its ids; `shards` has the number of ids
before each shard. A document's bits are blocks of BLOCK ids that begin at a byte and can be decoded alone: `blocks` has
their byte offsets, `marks` the bit offset within the block of every STRIDE-th id. A reader decodes all strides at once,
one table look-up each per step.

Codes are at most LIMIT bits long (package-merge), longer only if the vocabulary needs it. Null texts count as empty; each
document ends with the end id, so none is empty. Documents without an id come first; equal ids follow their texts' hash.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, keyed, pieces, settled

LIMIT, BLOCK, STRIDE = 16, 1 << 14, 64
#: Words of one generation of a worker's memory, some 200 bytes each.
KEPT = 400_000
#: Bytes of text encoded at once: the more, the fewer times a word is looked up.
TAKEN = 1 << 22

# Kinds of bytes: white space, letters (of ASCII and U+00C0 to U+00FF), digits, marks, apostrophe; others (0) are not parted
# from their neighbours.
_WHITE, _LETTER, _DIGIT, _MARK, _TICK = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _TICK
_KIND[0xC3] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Whether a word starts at a byte, by 8 * kind of the byte before + its own kind: after white space, at a digit, and where
#: letters, digits and marks meet, but not after an apostrophe, which may belong to the letters that follow ('s, 'll).
_START = np.zeros((8, 8), bool)
_START[_WHITE, [0, _LETTER, _DIGIT, _MARK, _TICK]] = True
_START[_LETTER, [_DIGIT, _MARK, _TICK]] = True
_START[_DIGIT, [_LETTER, _DIGIT, _MARK, _TICK]] = True
_START[_MARK, [_LETTER, _DIGIT]] = True
_START[_TICK, _DIGIT] = True
_START = _START.ravel()


def parted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words of several texts, where each word begins and the last ends, number of the words before each text.

    The tokenizer lower-cases, drops white space and parts letters, digits and marks anyway: the words, encoded alone, have
    the ids of the text. A stretch between white space stays one word as it is if it holds a character from U+0100 on, which
    may compose or lower-case otherwise, or the beginning of a special string.
    """
    n = len(data)
    kind, low = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data == 0xC3)  # of U+00C0 to U+00FF
    after = data[lead + 1]
    sign = after | 0x20 == 0xB7  # multiplication and division
    kind[lead + 1] = np.where(sign, 0, _LETTER)
    kind[lead[sign]] = 0
    low[lead + 1] = np.where((after < 0x9F) & ~sign, after + np.uint8(32), after)
    start = np.zeros(n, bool)
    start[1:] = _START[kind[:-1] << np.uint8(3) | kind[1:]]
    first = offs[:-1][offs[:-1] < n]
    start[first] = kind[first] != _WHITE
    black = kind != _WHITE
    kept = np.flatnonzero(data >= 0xC4)
    special = np.flatnonzero(data == 60)
    special = special[data[np.minimum(special + 1, n - 1)] == 124]
    if len(kept) or len(special):
        fresh = black.copy()
        fresh[1:] &= ~black[:-1]
        fresh[first] = black[first]
        at = np.append(np.flatnonzero(fresh), n)
        k = np.unique(np.searchsorted(at, np.concatenate((kept, special)), "right") - 1)
        edge = np.zeros(n + 1, np.int8)
        edge[at[k]] += 1
        edge[at[k + 1]] -= 1
        same = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        low[same] = data[same]
        start[same] = fresh[same]
    body = low[black]
    return body, np.append(np.flatnonzero(start[black]), len(body)), np.searchsorted(np.flatnonzero(start), offs)


def plain(text: str) -> str:
    """A text with the same ids: its words as `parted` gives them, a space between."""
    data = np.frombuffer(text.encode(), np.uint8)
    body, edge, _ = parted(data, np.array([0, len(data)]))
    return b" ".join(body[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])).decode()


# Fixed values of the tokenizer kind for which `plain` and word-wise encoding hold: what normalises, and what parts words.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space between words and marks, and encodes these alone."""
    normaliser, parts = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return ([x.get("type") for x in normaliser.get("normalizers", [])] == NORMALISERS
            and normaliser["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
            and parts[0].get("pattern") == {"Regex": WORDS} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
            and spec["model"].get("end_of_word_suffix") == "</w>")


def rows(array: pa.LargeBinaryArray, at: np.ndarray | None = None) -> list[bytes]:
    """The values of an array that is no slice, or with `at` those between these rows joined."""
    _, edge, raw = array.buffers()
    if raw is None or not len(array):
        return [b""] * (len(array) if at is None else len(at) - 1)
    edge, raw = np.frombuffer(edge, np.int64)[:len(array) + 1], raw.to_pybytes()
    edge = (edge if at is None else edge[at]).tolist()
    return [raw[a:b] for a, b in zip(edge, edge[1:])]


class Ids:
    """Ids of texts as bytes. Where the pre-tokenizer drops white space (`by_words`), words are encoded alone, by the library
    and once while they are remembered (two generations of bounded size). Any other tokenizer gets the texts whole and as
    they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.word_wise = by_words(json.loads(self.tok.to_str()))
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: pa.Array, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each text; `data` and `offs` hold their bytes."""
        if self.word_wise:
            return self.of(data, offs)
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    def of(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        body, edge, before = parted(data, offs)
        words = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(body)])
        words = words.dictionary_encode()
        values = pa.array(self.known(rows(words.dictionary)), pa.large_binary())
        ids = values.take(words.indices)
        return rows(ids, before)

    def known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        young, old = self.young, self.old
        new = []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        simple = [w for w in new if w.decode().isalpha()]
        for at in range(0, len(simple), 1 << 14):
            # Words of letters are one pre-token each: many are one text, parted again at the ids that end a word.
            some = simple[at:at + (1 << 14)]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize
            raw, edge = ids.tobytes(), [0, *ends.tolist()]
            if len(ends) == len(some):  # else a letter is none to the tokenizer: word by word below
                young.update(zip(some, [raw[a:b] for a, b in zip(edge, edge[1:])]))
        for at in range(0, len(new), 4096):
            some = [w for w in new[at:at + 4096] if w not in young]
            for w, e in zip(some, self.tok.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)):
                young[w] = np.array(e.ids, self.kind).tobytes()
        out = [young[w] for w in words]
        if len(young) > KEPT:
            self.young, self.old = {}, young
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Ids:
    return Ids(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge over sorted weights."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    level, leaves = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packed = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, packed])
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaves.append(place < n)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaves):
        own = int(flags[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """Canonical code of (ids, lengths): codes ascend by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.most = int(lengths.max()) if len(ids) else 1
        step = np.uint64(1) << (self.most - lengths).astype(np.uint64)
        first = np.cumsum(step) - step if len(ids) else step
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids] = first >> (self.most - lengths).astype(np.uint64)
        self.bits[ids] = lengths
        self.symbol = np.repeat(ids, step.astype(np.int64)).astype(np.uint32)
        self.length = np.repeat(lengths, step.astype(np.int64)).astype(np.uint8)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        """Bits, byte offsets of the blocks and bit offsets of the strides of each document; `ids` holds all, `counts` how many each."""
        if not len(ids):
            return [(b"", b"", b"")] * len(counts)
        bits = self.bits[ids]
        end = np.cumsum(bits)
        at = end - bits
        begin = np.cumsum(counts) - counts

        def every(step):  # each document's first id and every step-th after it, and how many those are
            n = -(-counts // step)
            return np.repeat(begin - step * (np.cumsum(n) - n), n) + step * np.arange(int(n.sum())), np.append(0, np.cumsum(n))
        head, block_of = every(BLOCK)
        size = -(-(np.append(at[head[1:]], end[-1]) - at[head]) // 8)
        offset = np.cumsum(size) - size
        at += np.repeat(8 * offset - at[head], np.diff(np.append(head, len(ids))))
        # A code meets at most three 16-bit cells; no two codes share a bit, so sums in floating point are exact.
        cell, shift = at >> 4, (48 - bits - (at & 15)).astype(np.uint64)
        wide = self.code[ids] << shift
        n = (int(size.sum()) + 1) // 2 + 3
        reach = 3 if self.most > 17 else 2
        out = sum(np.bincount(cell + k, (wide >> np.uint64(32 - 16 * k) & np.uint64(0xFFFF)).astype(np.float64), n) for k in range(reach))
        out = out.astype(">u2").tobytes()
        spot, mark_of = every(STRIDE)
        marks = (at[spot] - 8 * offset[np.searchsorted(head, spot, "right") - 1]).astype("<u4")
        edge = np.append(offset, size.sum())
        return [(out[edge[a]:edge[b]], (offset[a:b] - edge[a]).astype("<i8").tobytes(), marks[c:d].tobytes())
                for a, b, c, d in zip(block_of[:-1], block_of[1:], mark_of[:-1], mark_of[1:])]

    def decode(self, payloads: list[bytes], blocks: list[bytes], marks: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
        """Ids of several documents, all strides side by side."""
        base = np.cumsum([0] + [len(p) + 8 for p in payloads])
        data = np.frombuffer(b"".join(p + bytes(8) for p in payloads), np.uint8).astype(np.uint64)
        window = np.zeros(len(data), np.uint64)
        for k in range(5):
            window[:len(data) - 5] |= data[k:len(data) - 5 + k] << np.uint64(32 - 8 * k)
        lanes = -(-counts // STRIDE)
        where = []
        for b, o, m in zip(base, blocks, marks):
            m = np.frombuffer(m, "<u4").astype(np.int64)
            where.append(8 * (b + np.frombuffer(o, "<i8")[np.arange(len(m)) * STRIDE // BLOCK]) + m)
        at = np.concatenate(where) if where else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(counts)), lanes)
        left = counts[doc] - STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        order = np.argsort(-left, kind="stable")  # lanes with ids left are always the first ones
        left, at = left[order], at[order]
        out = np.zeros((STRIDE, len(at)), np.uint32)
        mask, spare = np.uint64((1 << self.most) - 1), np.uint64(40 - self.most)
        for s in range(STRIDE):
            live = int(np.searchsorted(-left, -s, "left"))
            here = at[:live]
            look = (window[here >> 3] >> (spare - (here & 7).astype(np.uint64)) & mask).astype(np.int64)
            out[s, :live] = self.symbol[look]
            here += self.length[look]
        out, left = out.T[np.argsort(order)], left[np.argsort(order)]
        flat = out[np.arange(STRIDE) < left[:, None]]
        return np.split(flat, np.cumsum(counts)[:-1])


def parts(batches, column: str, limit: int):
    """Slices of the batches with about `limit` bytes in a binary column, or one longer row."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy())
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a batch, and how many each row has."""
    if not batch.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw, wide = batch.column("ids").cast(pa.large_binary()), batch.column("wide")[0].as_py()
    edge = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], f"<u{wide}", int(edge[-1] - edge[0]) // wide, int(edge[0])), np.diff(edge) // wide


def write(docs: DataFrame, tokenizer: str, folder: str, end: int) -> None:
    """Encode all documents, end id appended, and write the folder.

    tokenizer  a tokenizer file, readable on every worker
    """
    settled(docs.sparkSession)

    def tokens(batches):
        ids = encoder(tokenizer)
        tail = np.array([end], ids.kind).tobytes()
        for part, data, offs in pieces(batches, limit=TAKEN):
            got = [x + tail for x in ids.whole(part.column("text"), data, offs)]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "k1": part.column("k1"), "k2": part.column("k2"),
                                              "wide": pa.array([ids.kind.itemsize] * len(got), pa.int32()), "ids": pa.array(got, pa.binary())})

    raw = cut(keyed(docs).mapInArrow(tokens, "doc_id long, k1 long, k2 long, wide int, ids binary"), "ids")

    def count(batches):
        encoder.cache_clear()  # a reused worker still holds the words of the stage before
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(joined(batch)[0], minlength=len(total))
            more[:len(total)] += total
            total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    spark = docs.sparkSession
    seen = raw.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    ids, n = np.array([r["id"] for r in seen], np.int64), np.array([r["n"] for r in seen], np.int64)
    lengths = code_lengths(n)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, bits long").coalesce(1).write.parquet(f"{folder}/code")
    sent = spark.sparkContext.broadcast(Code(ids, lengths))

    def pack(batches):
        encoder.cache_clear()
        code, before = sent.value, 0
        for batch in parts(batches, "ids", 1 << 20):
            ids, n = joined(batch)
            local = before + np.cumsum(n) - n
            before += len(ids)
            made = [(int(a), int(b), *x) for a, b, x in zip(local, n, code.encode(ids, n))]
            a, b, c, d, e = zip(*made) if made else ((),) * 5
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "shard": batch.column("shard"), "local": pa.array(a, pa.int64()), "n": pa.array(b, pa.int64()),
                "bits": pa.array(c, pa.binary()), "blocks": pa.array(d, pa.binary()), "marks": pa.array(e, pa.binary())})

    dealt = raw.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2").withColumn("shard", F.spark_partition_id())
    packed = dealt.select("doc_id", "shard", "wide", "ids").mapInArrow(
        pack, "doc_id long, shard int, local long, n long, bits binary, blocks binary, marks binary")
    packed.write.parquet(f"{folder}/documents")
    totals = spark.read.parquet(f"{folder}/documents").groupBy("shard").agg(F.sum("n").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{folder}/shards")


def _code(spark: SparkSession, folder: str) -> Code:
    rows = spark.read.parquet(f"{folder}/code").collect()
    return Code(np.array([r["id"] for r in rows], np.int64), np.array([r["bits"] for r in rows], np.int64))


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with `ids` the ids themselves."""
    sent = settled(spark).sparkContext.broadcast(_code(spark, folder))
    schema = "doc_id long, shard int, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def unpack(batches):
        code = sent.value
        for b in parts(batches, "bits", 1 << 20):
            got = code.decode(b.column("bits").to_pylist(), b.column("blocks").to_pylist(), b.column("marks").to_pylist(), b.column("n").to_numpy())
            out = {"doc_id": b.column("doc_id"), "shard": b.column("shard"), "local": b.column("local"),
                   "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                   "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64())}
            if ids:
                out["ids"] = pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    rows = spark.read.parquet(f"{folder}/documents").mapInArrow(unpack, schema)
    shards = spark.read.parquet(f"{folder}/shards")
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
