"""Dictated phrases: literal containment, shortlists, validation pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions import text as X
from ledgerloom.functions.groups import join_groups

#: Phrases of a registry, and bytes of their texts, up to which it is hinted to be broadcast.
BROADCAST_ANCHORS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bits of the anchors' filter: at most so many (8 MB), and some sixteen an anchor below that.
FILTER_BITS = 1 << 26
#: Phrases from which a token counts as hot in a shortlist.
HOT = 1000
WINDOWS = (32, 16, 8, 4, 2, 1)


def anchor_filter(anchors: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row with a Bloom filter of the hashes `_w` as an array of 64-bit words, and its number of bits.

    Two bits a hash. The array is built by aggregates and is at most FILTER_BITS long, whatever the registry's size.
    """
    bits = 1 << max(6, min(FILTER_BITS.bit_length() - 1, (16 * count).bit_length()))
    at = F.explode(F.array(*[_probe(F.col("_w"), i, bits) for i in range(2)]))
    words = anchors.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at").bitwiseAND(F.lit(63)).cast("int"))).alias("_v"))
    every = anchors.sparkSession.range(bits // 64).join(words, "id", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_v", F.lit(0).cast("bigint")).alias("v")))).alias("_f"))
    return row.select(F.col("_f.v").alias("_filter")), bits


def _probe(h: Column, i: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, 32 * i).bitwiseAND(F.lit(bits - 1).cast("bigint"))


def _maybe(h: Column, bits: int) -> Column:
    """Whether a hash may be in the row's `_filter`."""
    def there(i):
        at = _probe(h, i, bits)
        word = F.get(F.col("_filter"), F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) != 0
    return there(0) & there(1)


#: Characters looked at on either side of the blank of a phrase of two or three words.
EDGES = (4, 2, 1, 0)


def _longest(n: Column, sizes: Sequence[int]) -> Column:
    return F.coalesce(*[F.when(n >= w, F.lit(w)) for w in sizes])


def _gram(code, parts: Sequence[Column]) -> Column:
    return F.xxhash64(code, *parts)


def _anchored(reg: DataFrame) -> DataFrame:
    """Phrases `_p` with their anchor: its code `_n` (what `_text_hashes` computes) and hash `_w`.

    A text that holds a phrase holds its inner words, those with a blank on both sides, as words of its own. The anchor of four
    words or more is the longest run of three inner words (two, of four words); that of two or three words what meets at the
    first blank, up to four characters a side; that of a single word its leading window of 32, 16, ... characters.
    """
    reg = X.held(reg, "_ws", F.split("_p", " ", -1))
    n = F.size("_ws")

    def run(k):
        grams = F.transform(F.sequence(F.lit(1), n - 1 - k), lambda i: F.struct(
            sum((F.length(F.get("_ws", i + j)) for j in range(k)), F.lit(0)).alias("l"),
            _gram(F.lit(-k), [F.get("_ws", i + j) for j in range(k)]).alias("h")))
        return F.struct(F.lit(-k).alias("_n"), F.array_max(grams)["h"].alias("_w"))
    left, right = F.get("_ws", F.lit(0)), F.get("_ws", F.lit(1))
    a, b = _longest(F.length(left), EDGES), _longest(F.length(right), EDGES)
    code = 1000 + a * 10 + b
    edge = F.struct(code.alias("_n"), _gram(code, [F.right(left, a), F.left(right, b)]).alias("_w"))
    size = _longest(F.length("_p"), WINDOWS)
    single = F.struct(size.alias("_n"), _gram(size, [F.left("_p", size)]).alias("_w"))
    anchor = F.when(n >= 5, run(3)).when(n == 4, run(2)).when(n >= 2, edge).otherwise(single)
    return X.held(reg, "_a", anchor).select("_id", "_p", "_a._n", "_a._w")


def _text_hashes(text: str, codes: dict[int, int]) -> Column:
    """The distinct hashes of a text for every code of anchors; codes gives the shortest phrase of each."""
    none = F.array().cast("array<bigint>")

    def run(ws, n):
        return F.transform(ws, lambda x, i: _gram(F.lit(n), [x, *[F.get(ws, i + j) for j in range(1, -n)]]))

    def edges(ws, n):
        a, b = F.lit((n - 1000) // 10), F.lit(n % 10)
        return F.transform(ws, lambda x, i: _gram(F.lit(n), [F.right(x, a), F.left(F.coalesce(F.get(ws, i + 1), F.lit("")), b)]))

    def inside(ws, n):
        def windows(x):
            each = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: _gram(F.lit(n), [F.substr(x, i, F.lit(n))]))
            return F.when(F.length(x) >= n, each).otherwise(none)

        # a place in a long word is found by walking there, so windows are taken in pieces that reach into the next
        def long(w):
            return X.let(F.regexp_extract_all(w, F.lit("(?s).{1,128}"), F.lit(0)), lambda ps: F.flatten(F.transform(
                ps, lambda p, i: X.let(F.concat(p, F.coalesce(F.left(F.get(ps, i + 1), F.lit(n - 1)), F.lit(""))), windows))))
        enough = F.filter(F.array_distinct(ws), lambda w: F.length(w) >= codes[n])
        return F.flatten(F.transform(enough, lambda w: F.when(F.length(w) <= 128, windows(w)).otherwise(long(w))))

    def of(ws):
        return F.array_distinct(F.concat(none, *[(run if n < 0 else edges if n >= 1000 else inside)(ws, n) for n in sorted(codes)]))
    return X.let(F.split(F.col(text), " ", -1), of)


def literal_hits(texts: DataFrame, key: Sequence[str], text: str, registry: DataFrame, phrase_id: str = "id",
                 phrase: str = "phrase", min_len: int = 8) -> DataFrame:
    """(key..., phrase_id) for every phrase of at least `min_len` characters the text contains, case-folded.

    Phrases are anchored at their words (see `_anchored`), and the words of a text are hashed in place. Where the registry's
    counted size allows it to be broadcast, the hashes meet the phrases and candidates are verified in the row: nothing is
    shuffled. Otherwise the hashes pass a Bloom filter of the anchors, meet them by an ordinary join, and candidates are
    verified against the text. Every row of `texts` has its own hits, null keys included; a phrase_id with the same phrase
    twice is one entry.
    """
    reg = _anchored(registry.select(F.col(phrase_id).alias("_id"), F.lower(phrase).alias("_p")).where(
        F.length("_p") >= max(1, min_len)).distinct())
    # a row per code of anchors, some thirty at most
    sizes = reg.groupBy("_n").agg(F.count("*").alias("c"), F.min(F.length("_p")).alias("least"), F.sum(F.octet_length("_p")).alias("bytes")).collect()
    count, size = sum(r["c"] for r in sizes), sum(r["bytes"] for r in sizes)
    body = texts.select(*key, F.lower(X.as_col(text)).alias("_t")).where(F.length("_t") >= max(1, min_len))
    hashes = F.explode_outer(_text_hashes("_t", {r["_n"]: r["least"] for r in sizes})).alias("_w")
    out = [*key, F.col("_id").alias(phrase_id)]
    if count <= BROADCAST_ANCHORS and size <= BROADCAST_BYTES:
        held = X.held(body.select(*key, "_t"), "_t", F.col("_t")).select(*key, "_t", hashes)
        return held.join(F.broadcast(reg.select("_w", "_id", "_p")), "_w").where(F.contains("_t", "_p")).select(*out)
    body = body.withColumn("_h", F.xxhash64("_t"))
    grams = body.select(*key, "_h", hashes).where(F.col("_w").isNotNull())
    bloom, bits = anchor_filter(reg.select("_w").distinct(), count)
    grams = grams.crossJoin(F.broadcast(bloom)).where(_maybe(F.col("_w"), bits)).drop("_filter")
    cand = grams.join(reg.select("_w", "_id", "_p"), "_w").select(*key, "_h", "_id", "_p").distinct()
    return join_groups(cand, body, [*key, "_h"]).where(F.contains("_t", "_p")).select(*out)


def dictation_gate(prompts: DataFrame, label: str, text: str, registry: DataFrame, min_len: int = 1, **kw) -> DataFrame:
    """Violations: prompts that restate registry phrases. Empty means the gate passes."""
    return literal_hits(prompts, [label], text, registry, min_len=min_len, **kw)


# --- fixed value: punctuation stripped from tokens ---
TRIM = ".,;:()[]\"'"
# --- end of fixed value ---


def _tokens(text) -> Column:
    """Distinct lower-case words of more than three characters, their punctuation stripped."""
    words = F.filter(F.split(F.coalesce(X.as_col(text), F.lit("")), r"(?U)\s+", -1), lambda w: F.length(w) > 3)
    return F.array_distinct(F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(TRIM)))))


def shortlist(texts: DataFrame, key: Sequence[str], text: str, registry: DataFrame, order: str = "id",
              phrase: str = "phrase", k: int = 8, hot: int = HOT) -> DataFrame:
    """The k registry phrases sharing most tokens with a text, registry order on ties and as padding.

    `key` identifies a text. Texts meet the registry's inverted index on tokens and keep their best k by a group-limited
    top-k; what is missing is filled from the registry's first 2k entries, the only rows sent to every task. Tokens in
    more than `hot` phrases never meet the index: see `_bounded_votes`.
    """
    key = list(key)
    words = registry.select(F.col(order).alias("_id"), F.explode_outer(_tokens(phrase)).alias("_tok")).where(F.col("_tok").isNotNull())
    toks = texts.select(*key, F.explode_outer(_tokens(text)).alias("_tok")).where(F.col("_tok").isNotNull())
    rarity = words.groupBy("_tok").agg(F.count("*").alias("_df"))
    if (rarity.agg(F.max("_df")).first()[0] or 0) <= hot:
        votes = toks.join(words, "_tok").groupBy(*key, "_id").agg(F.count("*").cast("int").alias("_o"))
    else:
        votes = _bounded_votes(toks.join(rarity, "_tok"), words.join(rarity, "_tok"), key, k, hot)
    best = Window.partitionBy(*key).orderBy(F.col("_o").desc(), "_id")
    top = votes.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    top = top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_r", "_id", "_o"))).alias("_top"))
    first = registry.select(F.col(order).alias("_id")).orderBy("_id").limit(2 * k).agg(F.sort_array(F.collect_list("_id")).alias("_first"))
    rows = join_groups(texts.select(*key), top, key, "left").crossJoin(F.broadcast(first))
    found = F.transform(F.coalesce("_top", F.array().cast(top.schema["_top"].dataType)), lambda e: F.struct(e["_id"].alias("id"), e["_o"].alias("overlap")))
    pad = F.filter("_first", lambda i: ~F.exists(found, lambda e: e["id"] == i))
    fill = F.transform(F.slice(pad, F.lit(1), k - F.size(found)), lambda i: F.struct(i.alias("id"), F.lit(0).alias("overlap")))
    out = X.explode_rows(rows, key, F.concat(found, fill), "rank", "e")
    return out.select(*key, (F.col("rank") + 1).alias("rank"), F.col("e.id").alias(order), F.col("e.overlap").alias("overlap"))


def _bounded_votes(toks: DataFrame, words: DataFrame, key: Sequence[str], k: int, hot: int) -> DataFrame:
    """key..., _id, _o: shared tokens of every pair that can be among a text's first k.

    toks, words  tokens of texts and of phrases, with _df, the number of phrases that hold the token

    The rare tokens give each text candidates, at most `hot` a token. Its hot tokens, h of them, add h at most: candidates that
    lie more than h behind the k-th are dropped, the others are scored again with their own hot tokens. A phrase without
    a rare token in common scores h at most, so where the k-th candidate lies above h there is nothing more to find. For
    the other texts phrases with the same hot tokens are alike, and the first k of them stand for all; these meet the
    texts' different sets of hot tokens, once each.
    """
    votes = toks.where(F.col("_df") <= hot).join(words.where(F.col("_df") <= hot).select("_tok", "_id"), "_tok").groupBy(
        *key, "_id").agg(F.count("*").cast("int").alias("_c"))
    none = F.array().cast("array<string>")
    rest = toks.where(F.col("_df") > hot).groupBy(*key).agg(F.sort_array(F.collect_set("_tok")).alias("_rest"))
    tails = words.where(F.col("_df") > hot).groupBy("_id").agg(F.sort_array(F.collect_set("_tok")).alias("_hot"))

    order = Window.partitionBy(*key).orderBy(F.col("_c").desc(), "_id")
    placed = votes.withColumn("_r", F.row_number().over(order))
    kth = placed.where(F.col("_r") == k).select(*key, F.col("_c").alias("_kth"))
    known = join_groups(join_groups(votes, rest, key, "left"), kth, key, "left").withColumn("_rest", F.coalesce("_rest", none))
    near = known.where(F.col("_kth").isNull() | (F.col("_c") + F.size("_rest") >= F.col("_kth"))).join(tails, "_id", "left")
    exact = near.select(*key, "_id", (F.col("_c") + F.size(F.array_intersect("_rest", F.coalesce("_hot", none)))).alias("_o"))

    need = join_groups(rest, kth, key, "left").where(F.col("_kth").isNull() | (F.col("_kth") <= F.size("_rest"))).drop("_kth")
    heads = tails.withColumn("_r", F.row_number().over(Window.partitionBy("_hot").orderBy("_id"))).where(F.col("_r") <= k).drop("_r")
    sets = need.select("_rest").distinct()
    shared = sets.select("_rest", F.explode("_rest").alias("_tok")).join(
        heads.select("_hot").distinct().select("_hot", F.explode("_hot").alias("_tok")), "_tok").groupBy("_rest", "_hot").agg(F.count("*").cast("int").alias("_o"))
    best = Window.partitionBy("_rest").orderBy(F.col("_o").desc(), "_id")
    listed = shared.join(heads, "_hot").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    extra = need.join(listed.select("_rest", "_id", "_o"), "_rest").select(*key, "_id", "_o")
    return exact.unionByName(extra).groupBy(*key, "_id").agg(F.max("_o").alias("_o"))


def pools(spans: DataFrame, key: Sequence[str], sample: int | None = None) -> DataFrame:
    """Validation pools with flags dictated, literal, construct: POS, OVER and NEG, whole.

    sample  take only so many of each pool, by hash order (a group-limited top-k, so no task holds a whole pool)
    """
    pool = (F.when(F.col("dictated") & F.col("literal"), "POS").when(~F.col("dictated") & F.col("literal"), "OVER")
            .when(~F.col("dictated") & F.col("construct"), "NEG"))
    p = spans.withColumn("pool", pool).where(F.col("pool").isNotNull())
    if sample is None:
        return p
    p = p.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy("_h"))
    return p.withColumn("_r", rank).where(F.col("_r") <= sample).drop("_r", "_h")


def pool_counts(pooled: DataFrame, floor: int = 30) -> DataFrame:
    """Available spans per pool, pools without any included, and whether a registered floor is met."""
    g = pooled.agg(*[F.count_if(F.col("pool") == p).alias(p) for p in ("POS", "OVER", "NEG")])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), F.col(p).alias("available")) for p in ("POS", "OVER", "NEG")]))
    return g.select(each.alias("e")).select("e.pool", "e.available", (F.col("e.available") >= floor).alias("enough"))


def over_attribution(pooled: DataFrame, fired: str) -> DataFrame:
    """Share of OVER spans the matcher calls dictated, with its interval."""
    g = pooled.where("pool = 'OVER'").agg(F.count("*").alias("n"), F.count_if(F.col(fired)).alias("k"))
    lo, hi = S.wilson("k", "n")
    return g.select("n", "k", S.ratio("k", "n").alias("rate"), lo.alias("lo"), hi.alias("hi"))
