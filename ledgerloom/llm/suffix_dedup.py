"""Removal of long repeated byte strings by bucket-pointer refinement over a sparse set of suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus, the same document
included. Strings never cross documents and are judged on the input.

1. Buckets. Every window of `length` bytes names one q-gram in it: the one with the least hash, leftmost on ties. Equal
   windows name the same place, so only suffixes at named places are indexed (one in about half a window), in buckets by
   their q-gram. Buckets of one are done.
2. The context of a place is what its windows cover. Contexts that occur twice repeat as a whole. Where a bucket holds
   several contexts, one copy of each is refined: buckets of eight bytes are split by the bucket identifiers at later
   offsets, three at a time, each round reusing the identifiers of the round before (8, 24, 72, 216 bytes, ..., `length`);
   a suffix alone in its bucket is left out of later rounds. Starts that still share a bucket are repeats, byte for byte.
3. Buckets with more than HOT contexts are not held by one task. They are refined by shuffles: the window starts, counted
   from the place, are halved again and again; each half of a context goes to the bucket of the bytes that all its windows
   share. A half that is alone there has no repeat; contexts that agree on all bytes of the half repeat there as a whole,
   and one of them goes on to meet those that differ. Halves of one window end it. A context is carried by one row per
   halving and open half, however many there are. The result is the same.
4. The repeated windows of all copies are merged per document, and the bytes cut out.

Null texts are empty. Repeated rows are two places of the same text. Texts shorter than `length` stay whole.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, keyed, mix, pieces, runs, settled

LENGTH, GRAM, HOT = 400, 48, 512
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 21), base, np.uint64)
        full[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(full)
    return have[:n]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the bytes [p, p + gram) for every p."""
    n = len(data)
    if n < gram:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    return mix((total[gram:] - total[:-gram]) * powers(_INVERSE, n - gram + 1))


def places(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Named places of all texts: text number, place, first and last start of the windows that name it, q-gram hash."""
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    if len(h) < width:
        return none
    value = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // width)
    box = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    box[:len(h)] = value
    box = box.reshape(rows, width)
    ahead = np.minimum.accumulate(box, 1).ravel()
    back = np.minimum.accumulate(box[:, ::-1], 1)[:, ::-1].ravel()
    n = len(h) - width + 1
    named = (np.minimum(back[:n], ahead[width - 1:width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.maximum(np.diff(offs) - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    start = np.repeat(offs[:-1] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    named = named[start]
    if not len(start):
        return none
    turn = np.flatnonzero((named[1:] != named[:-1]) | (doc[1:] != doc[:-1])) + 1
    first, last = np.concatenate(([0], turn)), np.concatenate((turn - 1, [len(start) - 1]))
    d = doc[first]
    return d, named[first] - offs[d], start[first] - offs[d], start[last] - offs[d], h[named[first]]


def refined(data: np.ndarray, offs: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which positions start a string of `length` bytes that starts in another context of the same group too."""
    n = len(data)
    room = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)  # bytes to the context's end
    ids = np.full(n, -1, np.int64)
    at = np.flatnonzero(room >= min(8, length))
    depth = min(8, length)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(depth):
        word = word << np.uint64(8) | wide[k:k + n]
    first = np.unique(word[at], return_inverse=True)[1]
    owner = np.repeat(group, np.diff(offs))
    ids[at] = np.unique(owner[at] * (len(at) + 1) + first, return_inverse=True)[1]
    open_ = at
    while True:
        size = np.bincount(ids[ids >= 0])
        open_ = open_[size[ids[open_]] > 1]
        if depth == length or not len(open_):
            break
        far = min(length, 3 * depth)
        two, three = (far - depth + 1) // 2, far - depth
        new = np.full(n, -1, np.int64)
        go = open_[room[open_] >= far]
        top = int(ids.max()) + 2
        if top < 1 << 20:
            key = (ids[go] * top + ids[go + two]) * top + ids[go + three]
        else:
            key = np.unique(ids[go] * top + ids[go + two], return_inverse=True)[1].astype(np.int64) * top + ids[go + three]
        new[go] = np.unique(key, return_inverse=True)[1]
        alone = (ids >= 0) & (room >= far)
        alone[go] = False
        new[alone] = len(go) + np.arange(int(alone.sum()))
        ids, open_, depth = new, go, far
    out = np.zeros(n, bool)
    if depth == length:
        out[open_] = True
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents by key, spans by key): k1, k2, spans: array of (start, end) in bytes, one per run of repeated windows."""
    settled(docs.sparkSession)
    base = keyed(docs)

    def name(batches):
        for part, data, offs in pieces(batches):
            d, place, lo, hi, q = places(data, offs, length, gram)
            whole = memoryview(data)
            begin = offs[d]
            ctx = [int.from_bytes(blake2b(whole[a:b], digest_size=8, salt=(p % (1 << 32)).to_bytes(8, "little")).digest(), "little", signed=True)
                   for a, b, p in zip((begin + lo).tolist(), (begin + hi + length).tolist(), (place - lo).tolist())]
            yield pa.RecordBatch.from_pydict({"q": pa.array(q.view(np.int64)), "off": pa.array((place - lo).astype(np.int32)), "ctx": pa.array(ctx, pa.int64()), "k1": part.column("k1").take(pa.array(d)),
                                              "k2": part.column("k2").take(pa.array(d)), "lo": pa.array(lo), "hi": pa.array(hi)})

    named = cut(base.mapInArrow(name, "q long, off int, ctx long, k1 long, k2 long, lo long, hi long"), "places")
    twice = cut(named.groupBy("q").agg(F.count("*").alias("n")).where("n > 1").select("q"), "twice")
    hits = cut(named.join(twice, "q", "left_semi"), "hits")
    classes = cut(hits.groupBy("q", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi", "off")).alias("at")), "contexts")
    several = classes.groupBy("q").agg(F.count("*").alias("kinds")).where("kinds > 1")
    ask = cut(classes.join(several, "q").select("q", "ctx", "kinds", "at.*"), "ask")
    wanted = ask.groupBy("k1", "k2").agg(F.collect_set(F.struct("q", "ctx", "kinds", "lo", "hi", "off")).alias("all"))
    found = base.join(wanted, ["k1", "k2"]).select(F.col("text").cast("binary").alias("text"), F.explode("all").alias("r"))
    contexts = cut(found.select("r.q", "r.ctx", "r.off", (F.col("r.kinds") > HOT).alias("hot"), F.substring(
        "text", F.col("r.lo").cast("int") + 1, (F.col("r.hi") - F.col("r.lo")).cast("int") + length).alias("bytes"))
        .dropDuplicates(["q", "ctx"]), "bytes")

    def refine(batches):
        held, size = [], 0

        def done():
            table = pa.concat_tables(held)
            raw = table.column("bytes").to_pylist()
            offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
            q = table.column("q").to_numpy()
            ok = refined(np.frombuffer(b"".join(raw), np.uint8), offs, np.unique(q, return_inverse=True)[1], length)
            kept = [run_list(ok[a:b]) for a, b in zip(offs[:-1], offs[1:])]
            return pa.RecordBatch.from_pydict({"q": pa.array(q), "ctx": pa.array(table.column("ctx").to_numpy()),
                                               "runs": pa.array(kept, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))})

        for group in runs(batches, ["q"]):
            held.append(group)
            size += group.num_rows * 2 * length
            if size > 1 << 20:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    kind = "q long, ctx long, runs array<struct<a:long,b:long>>"
    usual = contexts.where("not hot").repartition("q").sortWithinPartitions("q").select("q", "ctx", "bytes").mapInArrow(refine, kind)

    large = narrowed(contexts.where("hot").select("q", "ctx", "off", "bytes"), length)
    partial = usual.unionByName(large).where("size(runs) > 0")
    whole = classes.where("n > 1").select("q", "ctx", F.array(F.struct(
        F.lit(0).cast("long").alias("a"), (F.col("at.hi") - F.col("at.lo")).alias("b"))).alias("runs"))
    known = cut(partial.join(whole.select("q", "ctx"), ["q", "ctx"], "left_anti").unionByName(whole), "runs")
    each = hits.join(known, ["q", "ctx"]).select("k1", "k2", F.transform(
        "runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("start"), (F.col("lo") + r["b"] + length).alias("end"))).alias("s"))
    return base, each.select("k1", "k2", F.explode("s").alias("s")).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


def narrowed(contexts: DataFrame, length: int) -> DataFrame:
    """q, ctx, runs of the repeated windows of large buckets, by halving (see 3. above)."""
    width = 1
    while 2 * width < length:
        width *= 2
    span = lambda start, size: F.md5(F.substring("bytes", (start + F.col("off") + 1).cast("int"), size.cast("int")))
    ends = (F.col("b") - F.col("a")).cast("int") + length
    # Starts relative to the place lie in (-length, 0]; halves are [g * width, (g + 1) * width).
    open_ = contexts.withColumn("g", F.explode(F.sequence(F.lit(length // -width), F.lit(0))))
    open_ = open_.withColumns({"first": -F.col("off"), "last": F.octet_length("bytes") - length - F.col("off")})
    found = None
    while True:
        part = open_.withColumns({"a": F.greatest("first", F.col("g") * width), "b": F.least("last", F.col("g") * width + (width - 1))}).where("a <= b")
        part = part.withColumns({"core": span(F.col("g") * width + (width - 1), F.lit(length - width + 1)), "same": span(F.col("a"), ends)})
        part = cut(part, "halves")
        key = ["q", "g", "core"]
        kinds = part.groupBy(*key, "a", "b", "same").agg(F.count("*").alias("n"), F.min("ctx").alias("one"))
        kinds = cut(kinds, "kinds")
        mixed = kinds.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1")
        whole = part.join(kinds.where("n > 1"), [*key, "a", "b", "same"]).select("q", "ctx", (F.col("a") + F.col("off")).alias("a"), (F.col("b") + F.col("off")).alias("b"))
        found = whole if found is None else found.unionByName(whole)
        if width == 1:
            break
        go = cut(part.join(kinds.join(mixed, key, "left_semi").select(*key, "a", "b", "same", F.col("one").alias("ctx")), [*key, "a", "b", "same", "ctx"], "left_semi"), "open")
        if not go.limit(1).count():
            break
        width //= 2
        open_ = go.select("q", "ctx", "off", "bytes", "first", "last", F.explode(F.array(F.col("g") * 2, F.col("g") * 2 + 1)).alias("g"))
    return found.groupBy("q", "ctx").agg(F.collect_set(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("runs"))


def run_list(ok: np.ndarray) -> list[dict]:
    """Runs of true values as first and last position."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
    return [{"a": a, "b": b - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document, and with `texts` removed (spans) and kept (bytes)."""
    base, spans = repeats(docs, length, gram)
    rows = base.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    more = ", removed array<struct<start:long,end:long>>, kept binary" * texts

    def strip(batches):
        for part, data, offs in pieces(batches):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
            for raw, given in zip((data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])), part.column("spans").to_pylist()):
                gone = merged(given or [])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                for k, v in zip(out, (len(raw), len(raw) - len(left), len(gone), sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in gone], left)):
                    out[k].append(v)
            cols = {"doc_id": part.column("doc_id"), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": out["kept_sha256"]}
            if texts:
                cols |= {"removed": pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(out["kept"], pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(strip, schema + more)
