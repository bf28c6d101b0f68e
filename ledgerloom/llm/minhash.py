"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find.

A signature of `slots` values is drawn from one random permutation of the slots per shingle: at step j a shingle offers
rank j + random to the j-th slot of its permutation, and a text stops at the step at which every slot is filled, since
later ranks are larger. All texts of a piece walk the steps together.

Texts with the same shingle set are one node. Nodes that share a band are compared on their full sets: first each with
the most central node of the band (the one that meets most others over all bands), which settles groups of near copies
without listing their pairs; then, in bands that still hold several components, all nodes outside the largest component
with all nodes of the band. Small bands list the pairs whose signatures allow a link; larger ones carry the full sets in
blocks and return only links that join components. No bucket is capped. Components come from minimum labels with pointer jumping, cut to the shared folder at each round.

Null and empty texts have no shingles and stay alone. Repeated rows share a node. A null doc_id takes no part in the
smallest id; a component of such rows only has a null component_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import GOLD, cut, fresh, keyed, mix, pieces, runs, settled, shingle_sets

SLOTS, ROWS = 112, 4
#: Nodes up to which a band lists pairs, and rows that one comparison step of a larger band holds on either side.
SMALL, BLOCK = 32, 256
LOW = np.uint64(0xFFFFFFFF)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of `slots` ranks (step in the high half, random number in the low) per set; sets must not be empty."""
    n = len(sets)
    x = np.concatenate(sets) if n else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    perm = None
    for j in range(slots):
        draw = mix(x + np.uint64((j + 1) * int(GOLD) & (1 << 64) - 1))
        pick = np.int64(j) + (((draw & LOW) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = pick
        else:
            i = np.arange(len(x))
            slot = perm[i, pick].astype(np.int64)
            perm[i, pick] = perm[:, j]
        np.minimum.at(out, doc * slots + slot, (draw >> np.uint64(32)) | np.uint64(j << 32))
        full = out.reshape(n, slots).max(axis=1) != np.iinfo(np.uint64).max
        on = ~full[doc]
        if not on.any():
            break
        if perm is None:
            x, doc, pick = x[on], doc[on], pick[on]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
            perm[np.arange(len(x)), pick] = 0
        elif not on.all():
            x, doc, perm = x[on], doc[on], perm[on]
    return out.reshape(n, slots)


def _marks(width: int, slots: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()),
                        ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def mark(batches):
        for part, data, offs in pieces(batches):
            sets = shingle_sets(data, offs, width)
            some = [i for i, s in enumerate(sets) if len(s)]
            node, bands, sig = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if some:
                full = superminhash([sets[i] for i in some], slots)
                short = ((full & LOW) ^ (full >> np.uint64(32)) * np.uint64(0x9E3779B1)).astype(np.uint32)
                band = full.reshape(len(some), slots // rows, rows)
                key = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64), band.shape[:2]).copy()
                for r in range(rows):
                    key = mix(key * GOLD + band[:, :, r])
                key = key.view(np.int64)
                for at, i in enumerate(some):
                    s = sets[i]
                    twice = (np.add.reduce(mix(s)), np.bitwise_xor.reduce(mix(s * GOLD + np.uint64(1))) + np.uint64(len(s)))
                    node[i], bands[i], sig[i] = np.array(twice).tobytes(), key[at], short[at].tobytes()
            yield pa.record_batch([part.column("doc_id"), part.column("k1"), part.column("k2"),
                                   pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()),
                                   pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema=schema)
    return mark, "doc_id long, k1 long, k2 long, n long, node binary, bands array<long>, sig binary"


def _verify(width: int, percent: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def verify(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            at = 0
            for part, data, offs in pieces([batch.select(["text_a"])], "text_a"):
                left = shingle_sets(data, offs, width)
                right = []
                for _, d, o in pieces([batch.slice(at, part.num_rows)], "text_b"):
                    right += shingle_sets(d, o, width)
                for i, (s, t) in enumerate(zip(left, right)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    linked[at + i] = 100 * both >= percent * (len(s) + len(t) - both)
                at += part.num_rows
            yield pa.record_batch([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(linked))
    return verify


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for nodes with an edge (a, b)."""
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        offer = edges.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("root").alias("near"))
        lower = labels.join(offer, F.col("node") == F.col("b")).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        lower = cut(lower, "lower")
        jump = lower.select(F.col("node").alias("at"), F.col("root").alias("to"))
        labels = cut(lower.join(jump, F.col("root") == F.col("at")).select("node", "was", F.least("root", "to").alias("root")),
                     "labels")
        if labels.where("was <> root").limit(1).count() == 0:
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def _compare(slots: int, percent: int):
    """Pairs of a block whose signatures agree nearly as often as the threshold asks, between components."""
    least = percent / 100 - 5.5 * np.sqrt(percent / 100 * (1 - percent / 100) / slots)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(batches):
        for group in runs(batches, ["band", "i", "j"]):
            node = group.column("node").to_pylist()
            comp = np.unique(np.array(group.column("comp").to_pylist(), object), return_inverse=True)[1]
            n, rest = group.column("n").to_numpy(), group.column("rest").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, slots)
            pairs = set()
            for at in np.flatnonzero(rest):
                ok = (comp != comp[at]) & (np.minimum(n, n[at]) * 100 >= percent * np.maximum(n, n[at]))
                hit = np.flatnonzero(ok)
                hit = hit[(sig[hit] == sig[at]).mean(axis=1) >= least]
                pairs.update((min(node[at], node[x]), max(node[at], node[x])) for x in hit)
            if pairs:
                a, b = zip(*pairs)
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)
    return compare


def _sets(width: int):
    def sets(batches):
        for part, data, offs in pieces(batches):
            yield pa.RecordBatch.from_pydict({"node": part.column("node"), "set": pa.array(
                [s.tobytes() for s in shingle_sets(data, offs, width)], pa.binary())})
    return sets


def _settle(percent: int):
    """Links of a block between components, no more than join them: full sets, counted for one node against all."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def settle(batches):
        for group in runs(batches, ["band", "i", "j"]):
            node = group.column("node").to_pylist()
            label = np.unique(np.array(group.column("comp").to_pylist(), object), return_inverse=True)[1]
            flat = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
            n = np.array([len(s) for s in flat])
            names, ids = np.unique(np.concatenate(flat), return_inverse=True)
            first = np.cumsum(n) - n
            mark, links = np.zeros(len(names), np.int32), []
            for r in np.flatnonzero(group.column("rest").to_numpy(zero_copy_only=False)):
                if (label == label[r]).all():
                    continue
                own = ids[first[r]:first[r] + n[r]]
                mark[own] = 1
                both = np.add.reduceat(mark[ids], first)
                mark[own] = 0
                hit = np.flatnonzero((100 * both >= percent * (n + n[r] - both)) & (label != label[r]))
                for h in hit[np.unique(label[hit], return_index=True)[1]]:
                    links.append((node[r], node[h]))
                    label[label == label[h]] = label[r]
            if links:
                a, b = zip(*links)
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)
    return settle


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, the row's key k1, k2, and the component's root.

    width    words of a shingle
    percent  100 * intersection >= percent * union links two texts
    """
    settled(docs.sparkSession)
    base = keyed(docs)
    mark, schema = _marks(width, slots, rows)
    marks = cut(base.mapInArrow(mark, schema), "marks")
    texts_of = marks.where("node is not null")
    nodes = cut(texts_of.groupBy("node").agg(
        F.min("doc_id").alias("id"), F.min(F.struct("k1", "k2")).alias("at"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")

    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    size = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    member = cut(banded.join(size, "band"), "members")
    reach = member.groupBy("node").agg(F.sum("size").alias("reach"))
    central = F.struct((-F.col("reach")).alias("reach"), "node", "n")
    member = cut(member.join(reach, "node").select("band", "size", "node", "n", central.alias("pivot")), "reach")
    pivot = member.groupBy("band").agg(F.min("pivot").alias("pivot"))
    member = cut(member.drop("pivot").join(pivot, "band"), "pivots")
    fits = f"least(n, pivot.n) * 100 >= {percent} * greatest(n, pivot.n)"
    star = cut(member.where("node <> pivot.node").where(fits)
               .select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct(), "star")
    linked = cut(confirmed(star, nodes, base, width, percent), "links")
    comps = components(linked)

    # Bands of three nodes or more, outside one component: the largest component's members need no comparing among themselves.
    placed = cut(member.where("size > 2").join(comps, "node", "left").select(
        "band", "node", F.coalesce("root", "node").alias("comp")), "placed")
    per = placed.groupBy("band", "comp").agg(F.count("*").alias("m"))
    mixed = cut(per.groupBy("band").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("k"))
                .where("top.m < k").select(
        "band", (F.col("k") > SMALL).alias("large"), F.col("top.comp").alias("main"),
        F.when(F.col("k") > SMALL, F.ceil(F.col("k") / BLOCK)).otherwise(1).cast("int").alias("nk"),
        F.when(F.col("k") > SMALL, F.ceil((F.col("k") - F.col("top.m")) / BLOCK)).otherwise(1).cast("int").alias("nr")), "mixed")
    side = placed.join(mixed, "band").withColumn("rest", F.col("comp") != F.col("main"))
    spot = F.xxhash64("node")
    as_all = side.withColumns({"i": F.pmod(spot, F.col("nk")), "j": F.explode(F.sequence(F.lit(0), F.col("nr") - 1))})
    as_rest = side.where("rest").withColumns({
        "j": F.pmod(spot, F.col("nr")), "i": F.explode(F.sequence(F.lit(0), F.col("nk") - 1))})
    key = ["band", "i", "j"]
    blocks = cut(as_all.select("large", *key, "node", "comp", F.lit(False).alias("rest")).unionByName(
        as_rest.select("large", *key, "node", "comp", "rest")), "blocks")
    small, large = blocks.where("not large"), blocks.where("large")
    small = small.join(nodes.select("node", "n", "sig"), "node").repartition(*key).sortWithinPartitions(*key)
    more = cut(small.mapInArrow(_compare(slots, percent), "a binary, b binary").distinct(), "rest")
    sets = texts_for(large.select("node").distinct(), nodes, base).mapInArrow(_sets(width), "node binary, set binary")
    large = large.join(cut(sets, "sets"), "node").repartition(*key).sortWithinPartitions(*key)
    joined = cut(large.mapInArrow(_settle(percent), "a binary, b binary"), "joined")
    late = cut(confirmed(more, nodes, base, width, percent).union(joined), "late")
    if late.limit(1).count():
        comps = components(linked.union(late))

    rooted = nodes.select("node", "id").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = cut(rooted.join(least, "root").select("node", "component_id", "root"), "named")
    out = marks.select("doc_id", "k1", "k2", "n", "node").join(named, "node", "left")
    whose = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whose.alias("component_id"),
                      F.coalesce(F.col("doc_id") == whose, F.lit(False)).alias("kept"), "k1", "k2", "root")


def texts_for(need: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """node, text of one document of each node needed."""
    at = need.join(nodes, "node").select("node", F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"))
    return base.join(at, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, nodes: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) whose full shingle sets are similar enough."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = cut(texts_for(need, nodes, base), "texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.mapInArrow(_verify(width, percent), "a binary, b binary")


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each near-duplicate group, all columns as they were.

    The document with the smallest id of a component stays; of rows without an id, or repeated rows, one stays.
    Texts without words are linked with nothing and all stay.
    """
    got = near_duplicates(docs, width, percent)
    chosen = got.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "k1", "k2")).alias("at")).select("at.k1", "at.k2")
    key1, key2, row = fresh(docs, "k1_"), fresh(docs, "k2_"), fresh(docs, "row_")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wordy = body.rlike(r"[^\x20\x09-\x0D]")
    full = docs.withColumns({key1: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), key2: F.xxhash64(body)})
    chosen = cut(chosen.withColumnsRenamed({"k1": key1, "k2": key2}), "chosen")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = full.where(wordy).join(chosen, [key1, key2], "left_semi").groupBy(key1, key2).agg(F.first(whole).alias(row))
    return one.select(f"{row}.*").unionByName(docs.where(~wordy))
