"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

Words are maximal runs of letters and digits of the lower-cased text; a shingle is five of them. Of an item with L words,
every window of L words of every document is judged by exact weighted Jaccard similarity of the two bags of shingles
(a shingle weighs as often as it occurs), and reported from `THRESHOLD` on.

1. Positions whose shingle belongs to an item of L words. A window of n shingles can only reach the threshold t if at
   least 2nt / (1 + t) of its shingles are such positions, so windows that hold fewer are left out without loss; and as a
   window may be moved right past a position that is none, windows start at such positions or end with the text.
   A text shorter than the item is one window.
2. Fingerprints: 64-bit SimHash of each window left and each item in which no shingle repeats.
3. Multi-index: the fingerprint is cut into RADIUS + 1 blocks. Two fingerprints within the radius agree in one block at
   least, so joining on (L, block, value) finds all of them. Without repeats the cosine of a pair at THRESHOLD is 8/9 at
   least, and RADIUS lies 4.6 deviations above the distance expected there: by the binomial tail one such window of
   100,000 is lost. A lower threshold than THRESHOLD would need a wider radius.
4. Verification of the candidates on the full bags.
5. Where a shingle repeats in the window or the item, the cosine may be far lower at the same similarity. Such pairs are
   judged by their exact overlap without fingerprints.

Null and empty texts, and items of fewer than five words, match nothing. Rows that repeat id and text share a verdict.
Items that share an item_id, or have none, are judged text by text, and the best one is reported.
Each table of items is broadcast only where its own rows, counted, are BROADCAST_ROWS at most (40 bytes each); beyond that
the join is an ordinary one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import let
from ledgerloom.llm.common import cut, fresh, keyed

WIDTH, RADIUS, BITS, THRESHOLD = 5, 23, 64, 0.8
BROADCAST_ROWS = 1_000_000


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(ws):
    """Hashes of all runs of WIDTH words; empty where there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(ws) - WIDTH), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WIDTH)]))
    return F.when(F.size(ws) >= WIDTH, each).otherwise(F.array().cast("array<bigint>"))


def grams(df: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The named columns with `sh`, the shingles of the text."""
    return df.select(*columns, let(words(F.col(text)), shingles).alias("sh"))


def repeats(sh):
    """Whether a shingle occurs more than once."""
    return let(F.col(sh), lambda g: F.size(F.array_distinct(g)) < F.size(g))


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """SimHash of the rows' `g` with weight `w`, per group."""
    votes = [F.sum(F.when(F.getbit("g", F.lit(b)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"v{b}") for b in range(BITS)]
    bits = None
    for b in range(BITS):
        one = F.when(F.col(f"v{b}") >= 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
        bits = one if bits is None else bits.bitwiseOR(one)
    return df.groupBy(*by).agg(*votes).select(*by, bits.alias("fp"))


def blocks(fp):
    """One struct (block, value) per block; the blocks share out the bits as evenly as they go."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.explode(F.array(*[F.struct(
        F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))]))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item found in it: doc_id, k1, k2, item_id, similarity, at (first word of the best window)."""
    bench = benchmark.select(F.col("item_id").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bench = bench.select(F.coalesce("item_id", F.lit(-1)).alias("item_id"), F.xxhash64("text").alias("item_key"), "text").distinct()
    bag = cut(grams(bench, ["item_id", "item_key"]).select(
        "item_id", "item_key", F.size("sh").alias("n"), repeats("sh").alias("again"), F.explode("sh").alias("g"))
              .groupBy("item_id", "item_key", "n", "again", "g").agg(F.count("*").alias("w")), "items")
    # An item has a row per shingle here, and a row per block of its fingerprint below.
    size = bag.agg(F.count("*").alias("rows"), F.count_distinct("item_id", "item_key").alias("items")).first()

    def small(df, rows=size["rows"]):
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df


    base = keyed(docs)
    spread = grams(base, ["doc_id", "k1", "k2"]).select("doc_id", "k1", "k2", F.size("sh").alias("have"), F.posexplode("sh").alias("pos", "g"))
    hit = spread.join(small(bag.select("g", "n").distinct()), "g")
    # A text's positions, bounded by its length; the need of hits for windows of m = min(n, have) shingles.
    found = hit.groupBy("k1", "k2", "n", "have").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    m = F.least("n", "have")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (m + F.col("n")) - 1e-9).cast("int")
    last = F.col("have") - m
    found = found.withColumns({"m": m, "need": need, "last": last}).where("size(p) >= need")
    starts = F.array_distinct(F.concat(
        F.filter(F.transform("p", lambda p, i: F.when(
            (p <= F.col("last")) & (F.coalesce(F.get("p", i + F.col("need") - 1), F.lit(1 << 31)) < p + F.col("m")), p)),
            lambda p: p.isNotNull()),
        F.when(F.get("p", F.size("p") - F.col("need")) >= F.col("last"), F.array("last")).otherwise(F.array().cast("array<int>"))))
    window = cut(found.select("k1", "k2", "n", "m", F.explode(starts).alias("at")), "windows")

    texts = base.join(window.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    inside = grams(texts, ["k1", "k2"]).join(window, ["k1", "k2"])
    key = ["k1", "k2", "n", "at", "m"]
    inside = inside.select(*key, F.slice("sh", F.col("at") + 1, F.col("m")).alias("sh"))
    inside = cut(inside.select(*key, repeats("sh").alias("again"), F.explode("sh").alias("g"))
                 .groupBy(*key, "again", "g").agg(F.count("*").alias("w")), "bags")
    once, plain = inside.where(~F.col("again")).drop("again"), bag.where(~F.col("again"))
    prints = fingerprint(once, key).select(*key, "fp", blocks(F.col("fp")).alias("b")).select(*key, "fp", "b.*")
    items = fingerprint(plain, ["item_id", "item_key", "n"]).select("item_id", "item_key", "n", F.col("fp").alias("ifp"), blocks(F.col("fp")).alias("b"))
    near = prints.join(small(items.select("item_id", "item_key", "n", "ifp", "b.*"), size["items"] * (RADIUS + 1)), ["n", "block", "value"]).where(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select(*key, "item_id", "item_key").distinct()
    weights = ["item_id", "item_key", "g", F.col("w").alias("iw")]
    both = near.join(once, key).join(small(plain.select(*weights)), ["item_id", "item_key", "g"])
    # Pairs with a repeat on either side, each met once.
    exact = inside.where("again").drop("again").join(small(bag.select("n", *weights)), ["n", "g"]).unionByName(
        once.join(small(bag.where("again").select("n", *weights)), ["n", "g"]))
    # Per text of an item: several may share an item_id, and all without one share -1.
    shared = both.unionByName(exact).groupBy(*key, "item_id", "item_key").agg(F.sum(F.least("w", "iw")).alias("c"))
    sure = shared.withColumn("similarity", F.col("c") / (F.col("m") + F.col("n") - F.col("c"))).where(F.col("similarity") >= threshold - 1e-12)
    best = sure.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("similarity", -F.col("at"))).alias("best"))
    return best.select(F.when(F.col("k1") != F.lit(-(1 << 63)), F.col("k1")).alias("doc_id"), "k1", "k2", "item_id",
                       F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("at"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a benchmark item in them, all columns as they were."""
    k1, k2 = fresh(docs, "k1_"), fresh(docs, "k2_")
    bad = cut(matches(docs, benchmark, threshold).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "leaks")
    full = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
                             k2: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return full.join(bad, [k1, k2], "left_anti").select(*[F.col(c) for c in docs.columns])
