"""Shared parts of the operators: materialised cuts, Arrow pieces of texts, hashed words and shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; arrays of eight bytes a byte of text stay within some tens of MB.
PIECE = 1 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session uses its warehouse folder; a cluster must
    name one, since its machines share no other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def cut(df: DataFrame, what: str = "cut", **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession) -> SparkSession:
    """Session options of these operators: small Arrow batches, since a row may hold a long text."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def byte_bound(spark: SparkSession, size: int = 16 << 20) -> SparkSession:
    """As `settled`, with Arrow batches of at most `size` bytes or one longer row."""
    settled(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def keyed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, text (null: empty), and a null-free key of a row's id and text: `k1`, `k2`.

    Rows that share both are the same document; rows that share an id only, or have none, are told apart by their text.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("doc_id"), body.alias("text")).withColumns({
        "k1": F.coalesce("doc_id", F.lit(NO_ID)), "k2": F.xxhash64("text")})


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[tuple]:
    """(rows, their bytes as one uint8 array, offsets) with at most `limit` bytes, or one longer text."""
    for batch in batches:
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        offs = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
        whole = text.buffers()[2]
        whole = np.frombuffer(whole, dtype=np.uint8) if whole is not None and whole.size else np.empty(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), whole[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
            at = to


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share a key, from batches sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        turn = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k)
            turn[1:] |= np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True))
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        turn[0] = last is not None and first != last
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        at = 0
        for to in np.flatnonzero(turn):
            held.append(batch.slice(at, to - at))
            if any(h.num_rows for h in held):
                yield pa.Table.from_batches(held)
            held, at = [], int(to)
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = mix(np.arange(1, 257, dtype=np.uint64) * GOLD) | np.uint64(1)


def factors(n: int) -> np.ndarray:
    """Odd pseudo-random factors of byte positions."""
    global _FACTORS
    if n > len(_FACTORS):
        _FACTORS = mix(np.arange(1, 2 * n, dtype=np.uint64) * GOLD) | np.uint64(1)
    return _FACTORS


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word; words end at ASCII white space, A-Z count as a-z."""
    inside = ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    val = _LOWER[data[inside]].astype(np.uint64) + np.uint64(1)
    val *= factors(int(lens.max()))[pos]
    h = np.add.reduceat(val, first)
    return mix(h + lens.astype(np.uint64) * GOLD), np.searchsorted(offs, starts, "right") - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its word shingles; fewer words than `width` are one shingle."""
    h, doc = word_hashes(data, offs)
    count = np.bincount(doc, minlength=len(offs) - 1)
    at = np.concatenate(([0], np.cumsum(count)))
    roll = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        roll = mix(roll * np.uint64(0xD6E8FEB86659FD93) + h[j:j + len(roll)] + GOLD)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(roll[a:b - width + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for w in h[a:b]:
                x = mix(x * np.uint64(0xA0761D6478BD642F) + w + np.uint64(b - a))
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out
