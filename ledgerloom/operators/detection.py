"""Detectors over text tables: counts, densities, consensus, thresholds, profiles, phrases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon


def density(text, lex) -> Column:
    """Matches per 1,000 characters; empty text gives 0."""
    n = F.length(X.as_col(text))
    return F.when(n > 0, X.total_count(text, lex) / n * 1000).otherwise(F.lit(0.0))


def disposition(df: DataFrame, text: str, lex, keep: Sequence[str]) -> DataFrame:
    """Density, breadth (families present over families) and composite = density * sqrt(breadth)."""
    k = len(lexicon(lex))
    base = df.select(*keep, density(text, lex).alias("density"),
                     F.bit_count(X.families_mask(text, lex)).alias("_k"))
    return base.select(*keep, "density", (F.col("_k") / k).alias("breadth"),
                       (F.col("density") * F.sqrt(F.col("_k") / k)).alias("composite"))


def lift_ratio(scored: DataFrame, case: str, mode: str, value: str, top: str, base: str) -> DataFrame:
    """Mean of one mode over the paired mode per case; null when either is zero or missing."""
    g = scored.groupBy(case).agg(
        F.avg(F.when(F.col(mode) == top, F.col(value))).alias("a"),
        F.avg(F.when(F.col(mode) == base, F.col(value))).alias("b"))
    return g.select(case, "a", "b", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") / F.col("b")).alias("lift"))


def family_density(turns: DataFrame, lex, by: Sequence[str] = ("seat",)) -> DataFrame:
    """Mean density per family and seat."""
    n = F.length("text")
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), F.when(n > 0, c / n * 1000).otherwise(F.lit(0.0)).alias("d"))
        for f, c in X.family_counts("text", lex).items()]))
    return turns.select(*by, each.alias("e")).groupBy(*by, "e.family").agg(
        F.count("*").alias("n"), F.avg("e.d").alias("density"))


def family_owner(densities: DataFrame, floor: float = 0.3) -> DataFrame:
    """The seat with the highest density per family (first name on ties), or below detection."""
    g = densities.withColumn("_d", F.round("density", 9)).groupBy("family").agg(
        F.min(F.struct((-F.col("_d")).alias("d"), "seat")).alias("b"))
    return g.select("family", F.when(-F.col("b.d") > floor, F.col("b.seat")).otherwise("below detection").alias("owner"),
                    (-F.col("b.d")).alias("density"))


def consensus_mask(masks: Sequence, lex, k: int = 2) -> Column:
    """Families at least k detectors agree on, from their masks in the same row."""
    if len(masks) < 2 or not 1 <= k <= len(masks):
        raise ValueError("consensus needs at least two instruments and 1 <= k <= n")
    bits = []
    for i, _ in enumerate(lexicon(lex)):
        votes = reduce(lambda a, b: a + b, [X.mask_has(m, i).cast("int") for m in masks])
        bits.append(F.when(votes >= k, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def consensus(detections: DataFrame, k: int = 2) -> DataFrame:
    """The same over a detections table (text_id, instrument, family): any detector can take part."""
    return detections.groupBy("text_id", "family").agg(F.count_distinct("instrument").alias("votes")).where(
        F.col("votes") >= k)


def threshold_detect(scores: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Score-based presence: the maximum reaches the family's threshold; density = hits per 10 sentences."""
    cut = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    s = scores.withColumn("_t", F.try_element_at(cut, F.col("family"))).where(F.col("_t").isNotNull())
    return s.groupBy("text_id", "family").agg(
        F.max("score").alias("max_score"), F.count_if(F.col("score") >= F.col("_t")).alias("hits"),
        F.count("*").alias("sentences"), (F.max("score") >= F.max("_t")).alias("present")).withColumn(
        "density", F.col("hits") * 10 / F.col("sentences"))


def profile(df: DataFrame, text: str, terms: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Domain terms per 1,000 characters, mean sentence length, list share, type/token ratio."""
    t = X.as_col(text)
    low = F.lower(t)
    per_k = F.greatest(F.length(t) / 1000, F.lit(1e-9))
    rates = [
        (reduce(lambda a, b: a + b, [F.contains(low, F.lit(k.lower())).cast("int") for k in ks]) / per_k).alias(f"rate_{d}")
        for d, ks in terms.items()]
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x) != "")
    items = F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 2).isin("- ", "* "))
    toks = F.filter(F.transform(F.filter(F.split(low, r"(?U)\s+", -1), lambda w: w != ""),
                                lambda w: F.regexp_replace(w, r"""^[.,;:()\[\]"'*#]+|[.,;:()\[\]"'*#]+$""", "")),
                    lambda w: w != "")
    sents = F.filter(F.split(F.translate(t, "!?", ".."), r"\.", -1), lambda s: (F.length(s) > 15) & (F.length(s) < 600))
    base = df.select(*keep, *rates, F.length(t).alias("chars"), lines.alias("_l"), items.alias("_i"), toks.alias("_t"),
                     sents.alias("_s"))
    total = F.aggregate("_s", F.lit(0), lambda a, s: a + F.length(s))
    return base.select(
        *keep, *[f"rate_{d}" for d in terms], "chars",
        (total / F.greatest(F.size("_s"), F.lit(1))).alias("mean_sentence"),
        (F.size("_i") / F.greatest(F.size("_l"), F.lit(1))).alias("list_share"),
        (F.size(F.array_distinct("_t")) / F.greatest(F.size("_t"), F.lit(1))).alias("ttr"))


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Merge overlapping (start, end) ranges of one text; the earliest start keeps its label.

    Ranges of one text are bounded by the text, so the window per text is too.
    """
    order = Window.partitionBy(key).orderBy("start", "end", "label")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    isl = ranges.withColumn("_new", new).withColumn("_isl", F.sum("_new").over(order))
    return isl.groupBy(key, "_isl").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("label", F.struct("start", "end", "label")).alias("label")).drop("_isl")


# --- fixed values: quote delimiters, example markers and their limits ---
QUOTED = "\"[^\"]*\"|“[^”]*”|(?<![\\p{L}\\p{N}])'[^']*'|‘[^’]*’"
EXAMPLE_MARKERS = ("Example:", "example:", "e.g.", "E.g.", "for example", "For example")
EXAMPLE_CHARS, PHRASE_MIN, PHRASE_MAX = 320, 3, 400
# --- end of fixed values ---


def quoted(text) -> Column:
    """Quoted strings in reading order: one alternation scanned left to right, unmatched openers skipped."""
    return F.transform(F.regexp_extract_all(X.as_col(text), F.lit(QUOTED), F.lit(0)),
                       lambda q: X.strip(F.substr(q, F.lit(2), F.length(q) - 2)))


def examples(text, markers: Sequence[str] = EXAMPLE_MARKERS) -> Column:
    """What follows each example marker, up to a blank line or else 320 characters."""
    def after(m):
        def tails(cut):
            return F.when(F.size(cut) > 1, F.transform(
                F.sequence(F.lit(2), F.size(cut)), lambda i: clean(F.array_join(F.slice(cut, i, F.size(cut)), m)))
            ).otherwise(F.array().cast("array<string>"))

        return X.let(F.split(X.as_col(text), "\\Q" + m + "\\E", -1), tails)

    def clean(t):
        seg = F.when(F.contains(t, F.lit("\n\n")), F.substring_index(t, "\n\n", 1)).otherwise(F.substring(t, 1, EXAMPLE_CHARS))
        return X.strip(F.regexp_replace(X.strip(seg), "^-+|-+$", ""))

    return F.flatten(F.array(*[after(m) for m in markers]))


def extract_phrases(prompts: DataFrame, symbol: str, text: str, markers: Sequence[str] = EXAMPLE_MARKERS) -> DataFrame:
    """Distinct dictated phrases (3 to 400 characters) per source: quoted strings, then examples."""
    found = F.concat(
        F.transform(quoted(text), lambda q: F.struct(F.lit("quoted").alias("kind"), q.alias("phrase"))),
        F.transform(examples(text, markers), lambda q: F.struct(F.lit("example").alias("kind"), q.alias("phrase"))))
    rows = X.explode_rows(prompts, [symbol], found, "pos", "e").select(
        symbol, "pos", "e.kind", X.norm(F.col("e.phrase"), "space").alias("phrase"))
    rows = rows.where(F.length("phrase").between(PHRASE_MIN, PHRASE_MAX))
    return rows.groupBy(symbol, F.lower("phrase").alias("_low")).agg(
        F.min(F.struct("pos", "kind", "phrase")).alias("f")).select(symbol, "f.*")


def registry_digest(registry: DataFrame, order: str, *fields: str, fan: int = 1024, levels: int = 3) -> DataFrame:
    """Order-sensitive digest of a table of any size: hashes of at most `fan` ordered hashes, level by level.

    At least `levels` levels; more where the order keys need them for one digest to be left.
    """
    ends = registry.agg(F.min(F.col(order).cast("bigint")), F.max(F.col(order).cast("bigint"))).first()
    low, reach = min(ends[0] or 0, 0), (ends[1] or 0) - min(ends[0] or 0, 0)
    while reach >= fan ** levels:
        levels += 1
    cur = registry.select((F.col(order).cast("bigint") - low).alias("_o"), F.sha2(F.to_json(F.array(*[
        F.col(f).cast("string") for f in fields])), 256).alias("_h"))
    for _ in range(levels):
        g = cur.groupBy(F.floor(F.col("_o") / fan).alias("_g")).agg(
            F.sort_array(F.collect_list(F.struct("_o", "_h"))).alias("_l"))
        cur = g.select(F.col("_g").alias("_o"), F.sha2(F.array_join(F.transform("_l", lambda e: e["_h"]), ""), 256).alias("_h"))
    return cur.select(F.col("_h").alias("digest"))


def scaffold_overlap(prompts: DataFrame, text: str, lex) -> DataFrame:
    """Which patterns of a lexicon occur in the prompts themselves (dictated) and which do not (clean)."""
    pats = [(f, i, p) for f, ps in lexicon(lex).items() for i, p in enumerate(ps)]
    one = prompts.agg(*[F.coalesce(F.bool_or(X.has(text, p)), F.lit(False)).alias(f"p{n}") for n, (_, _, p) in enumerate(pats)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern"), F.col(f"p{n}").alias("dictated"))
        for n, (f, i, p) in enumerate(pats)]))
    return one.select(rows.alias("e")).select("e.*")


def rubric_hits(runs: DataFrame, case: str, text: str, rubric: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per case and rubric entry: outputs with a hit and total hits."""
    each = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rubric"), reduce(lambda a, b: a + b, [X.pattern_count(text, p) for p in ps]).alias("k"))
        for r, ps in rubric.items()]))
    return runs.select(case, each.alias("e")).groupBy(case, "e.rubric").agg(
        F.count_if(F.col("e.k") > 0).alias("outputs"), F.sum("e.k").alias("hits"))
