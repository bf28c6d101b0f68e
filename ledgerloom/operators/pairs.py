"""Preparation of counterfactual corpora and preference pairs from run tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.detectors import detector, plain
from ledgerloom.functions import text as X
from ledgerloom.functions.alignment import differing
from ledgerloom.functions.prefix import below
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import detection as D


# ---------------------------------------------------------------- ablation and corpora

#: Steps of a search by halving.
STEPS = [1 << k for k in range(30, -1, -1)]


def sentence_hits(spans, sentences, drop: Column | None = None) -> Column:
    """Per sentence whether some span (of the families in drop, where given) starts inside its offsets.

    spans  sorted by their start, which is searched for by halving: no sentence reads all spans of its text
    """
    named = X.as_col(spans) if drop is None else F.filter(spans, lambda p: F.array_contains(drop, p["family"]))
    at = F.transform(named, lambda p: p["start"])

    def inside(e, s):
        def halved(pos, step):
            return F.when((pos + step <= F.size(e["at"])) & (F.get(e["at"], pos + step - 1) < s["start"]), pos + step).otherwise(pos)
        return F.coalesce(F.get(e["at"], F.aggregate(e["steps"], F.lit(0), halved)) < s["end"], F.lit(False))

    def located(starts):
        steps = F.filter(F.array(*[F.lit(x) for x in STEPS]), lambda x: x <= F.size(starts))
        return X.let(F.struct(starts.alias("at"), steps.alias("steps")), lambda e: F.transform(sentences, lambda s: inside(e, s)))
    return X.let(at, located)


def sentences_hit(spans, sentences) -> Column:
    """The offsets of the sentences inside which some span starts, in order: each span looks its sentence up by halving."""
    def placed(e, p):
        def halved(pos, step):
            return F.when((pos + step <= F.size(e["at"])) & (F.get(e["at"], pos + step - 1) <= p["start"]), pos + step).otherwise(pos)
        return X.let(F.aggregate(e["steps"], F.lit(0), halved), lambda n: F.when(F.get(e["so"], n - 1)["end"] > p["start"], n - 1))

    def located(so):
        steps = F.filter(F.array(*[F.lit(x) for x in STEPS]), lambda x: x <= F.size(so))
        return X.let(F.struct(so.alias("so"), F.transform(so, lambda s: s["start"]).alias("at"), steps.alias("steps")), lambda e: F.transform(
            F.array_distinct(F.array_compact(F.transform(spans, lambda p: placed(e, p)))), lambda i: F.get(e["so"], i)))
    return X.let(sentences, located)


def _located(df: DataFrame, text: str, lex) -> DataFrame:
    """With spans, offsets of sentences and the sentences of a text; a detector that joins a table has detections for the part
    of the column's name."""
    det = detector(lex)
    found = plain(X.held(det.prepared(df, [text]), "_sp", det.spans(text, F.col(text))))
    both = F.struct(X.sentence_offsets(text).alias("so"), X.sentences(F.coalesce(F.col(text), F.lit(""))).alias("ss"))
    return X.held(found, "_sents", both).withColumns({"_so": F.col("_sents.so"), "_ss": F.col("_sents.ss")}).drop("_sents")


def ablate(df: DataFrame, text: str, lex, drop: str | None = None, out: str = "ablated") -> DataFrame:
    """Drop the sentences in which a span of the named families starts (all families without `drop`).

    drop  array column of family names. Text without such a span is returned unchanged.
    """
    return _without(_located(df, text, lex), text, drop, out).drop("_sp", "_so", "_ss")


def _without(d: DataFrame, text: str, drop: str | None, out: str) -> DataFrame:
    """`ablate` of texts whose spans and sentences are located."""
    dropped = F.col(drop) if drop else None
    none = F.size("_sp") == 0 if drop is None else ~F.exists("_sp", lambda p: F.array_contains(dropped, p["family"]))
    keep = X.let(sentence_hits("_sp", "_so", dropped), lambda hits: F.filter("_ss", lambda _, i: ~F.get(hits, i)))
    rebuilt = X.strip(F.array_join(F.transform(keep, lambda s: X.strip(s)), " "))
    return d.withColumn(out, F.when(none, F.col(text)).otherwise(rebuilt))


def supply_variants(runs: DataFrame, lex, keep: Sequence[str], upstream: str = "upstream", min_chars: int = 0) -> DataFrame:
    """Matched variants of each run from all families down to none, removing one family at a time in name order.

    One row per (keep..., kept): the variant parts, the families still found and their number.
    """
    names = sorted(lexicon(lex))
    joined = F.array_join(F.filter(upstream, lambda t: t != ""), "\n\n")
    present = X.held(runs.select(*keep, upstream), "_fam", X.mask_names(X.families_mask(joined, lex), lex))
    # a removed sentence is removed from its own part, so parts are located and ablated one by one
    parts = _located(present.select(*keep, "_fam", F.posexplode_outer(upstream).alias("_i", "_t")).where(F.col("_t").isNotNull()), "_t", lex)
    steps = parts.select("*", F.explode(F.sequence(F.lit(0), F.size("_fam"))).alias("kept"))
    cut = _without(steps.withColumn("_drop", F.slice("_fam", F.col("kept") + 1, F.size("_fam"))), "_t", "_drop", "_a")
    cut = X.held(cut.select(*keep, "kept", "_i", "_a"), "_a", F.col("_a")).withColumn("_m", X.families_mask("_a", lex))
    # parts per run are as many as the run has sources
    g = cut.groupBy(*keep, "kept").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_a"))), lambda e: e["_a"]).alias("variant"),
        F.bit_or("_m").alias("_m"))
    return g.where(F.aggregate("variant", F.lit(0), lambda a, t: a + F.length(t)) >= min_chars).select(
        *keep, "kept", "variant", X.mask_names("_m", lex).alias("families"), F.bit_count("_m").alias("supply"))


def build_corpus(runs: DataFrame, lex, prompt: str = "prompt_id", order: str = "run_id", min_chars: int = 200) -> DataFrame:
    """First run of each prompt (in a stated order), expanded to its supply variants of at least 200 characters."""
    first = runs.groupBy(prompt).agg(F.min_by(F.struct(F.col(order), F.col("upstream")), order).alias("_r")).select(
        prompt, F.col(f"_r.{order}").alias(order), "_r.upstream")
    return supply_variants(first, lex, [prompt, order], min_chars=min_chars)


def injection_bank(sentences: DataFrame, case: str, order: Sequence[str], sentence: str, lex, lo: int = 40, hi: int = 400) -> DataFrame:
    """Per case and family the first sentence (in order) of 40 to 400 characters that carries exactly that family."""
    s = sentences.where(F.length(sentence).between(lo, hi)).withColumn("_m", X.families_mask(sentence, lex))
    s = s.where(F.bit_count("_m") == 1).withColumn("family", F.get(X.mask_names("_m", lex), F.lit(0)))
    return s.groupBy(case, "family").agg(F.min_by(F.col(sentence), F.struct(*order)).alias("sentence"))


def inject_variants(runs: DataFrame, bank: DataFrame, case: str, key: str, lex, upstream: str = "up") -> DataFrame:
    """Append missing families one after another to a run's text, in the lexicon's order.

    At most one row per family and run: the bank of a case is an array no longer than the lexicon.
    """
    order = F.create_map(*[x for i, f in enumerate(lexicon(lex)) for x in (F.lit(f), F.lit(i))])
    packed = bank.groupBy(case).agg(F.sort_array(F.collect_list(F.struct(
        F.try_element_at(order, F.col("family")).alias("i"), "family", "sentence"))).alias("_bank"))
    # families are found before the join, so the join result carries them as a plain column
    j = runs.withColumn("_have", X.families(upstream, lex)).join(packed, case)
    miss = F.filter("_bank", lambda e: ~F.array_contains(F.col("_have"), e["family"]))
    rows = X.explode_rows(j.withColumn("_miss", miss), [case, key, upstream, "_miss"], F.col("_miss"), "_n", "_e")
    used = F.slice("_miss", 1, F.col("_n") + 1)
    text = F.concat(F.col(upstream), F.array_join(F.transform(used, lambda e: F.concat(F.lit("\n\n"), e["sentence"])), ""))
    out = rows.select(case, key, (F.col("_n") + 1).alias("step"), F.array_join(F.transform(used, lambda e: e["family"]), "+").alias("injected"), text.alias("variant"))
    return out.withColumn("supply", F.bit_count(X.families_mask("variant", lex)))


def ablate_labelled(sentences: DataFrame, labels: DataFrame, unit: str, pos: str, sentence: str) -> DataFrame:
    """Text without the sentences both judges flag, with removed and remaining counts (unlabelled stay).

    labels  unit, pos, flag (null = unusable)
    """
    j = sentences.join(labels, [unit, pos], "left")
    gone = F.coalesce(F.col("flag"), F.lit(False))
    # the sentences of one text are bounded by the text
    return j.groupBy(unit).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~gone, F.struct(F.col(pos), F.col(sentence).alias("s"))))),
                                 lambda e: X.strip(e["s"])), " ").alias("ablated"),
        F.count_if(gone).alias("removed"), F.count_if(F.col("flag").isNull()).alias("unlabelled"), F.count("*").alias("sentences"))


def verify_reference(items: DataFrame, target: str, reference: str, lex) -> DataFrame:
    """Reference families must equal the target set: missing and unsourced families otherwise."""
    got = items.withColumn("_g", X.families(reference, lex))
    return got.withColumn("missing", F.array_sort(F.array_except(target, "_g"))).withColumn(
        "unsourced", F.array_sort(F.array_except("_g", target))).withColumn(
        "ok", (F.size("missing") == 0) & (F.size("unsourced") == 0)).drop("_g")


# ---------------------------------------------------------------- minimal pairs

def drop_pairs(refs: DataFrame, text: str, targets: str, lex, keep: Sequence[str], min_chars: int = 200) -> DataFrame:
    """chosen = reference, rejected = reference without the first sentence in which a target family's span starts."""
    d = _located(refs, text, lex)
    rows = d.select(*keep, text, "_sp", "_so", F.explode_outer(targets).alias("family")).where(F.col("family").isNotNull())
    first = F.array_position(sentence_hits("_sp", "_so", F.array("family")), True).cast("int")
    rows = X.held(rows, "_h", F.get("_so", first - 1)).where(F.col("_h").isNotNull())
    rejected = X.strip(F.concat(F.substr(F.col(text), F.lit(1), F.col("_h.start")),
                                F.substr(F.col(text), F.col("_h.end") + 1, F.length(text))))
    return rows.select(*keep, F.lit("drop").alias("kind"), "family", F.col(text).alias("chosen"), rejected.alias("rejected"),
                       F.array("_h").alias("chosen_spans")).where(F.length("rejected") >= min_chars)


def invention_pairs(refs: DataFrame, text: str, targets: str, injections: dict[str, str], lex, keep: Sequence[str]) -> DataFrame:
    """rejected = reference plus one unsourced, detectable sentence in front of its second sentence."""
    usable = {}
    for fam, s in sorted(injections.items()):
        if any(re.search(p, s, re.I) for p in lexicon(lex).get(fam, [])):
            usable[fam] = s.strip()
    if not usable:
        raise ValueError("no injection exhibits its own family")
    d = X.held(refs, "_so", X.sentence_offsets(text)).where(F.size("_so") > 0)
    at = F.get("_so", F.least(F.lit(1), F.size("_so") - 1))["start"]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("s")) for f, s in usable.items()]))
    rows = d.select(*keep, text, targets, at.alias("_at"), each.alias("_e")).where(~F.array_contains(targets, F.col("_e.family")))
    rejected = F.concat(F.substr(F.col(text), F.lit(1), F.col("_at")), "_e.s", F.lit(" "), F.substr(F.col(text), F.col("_at") + 1, F.length(text)))
    return rows.select(*keep, F.lit("invention").alias("kind"), F.col("_e.family").alias("family"), F.col(text).alias("chosen"), rejected.alias("rejected"),
                       F.array(F.struct(F.col("_at").alias("start"), (F.col("_at") + F.length("_e.s")).alias("end"))).alias("rejected_spans"))


def feature_mask(df: DataFrame, text: str, lex, out: str = "mask", sentence_level: bool = True) -> DataFrame:
    """Character spans of the feature: whole sentences in which a span starts, or the bare spans."""
    d = _located(df, text, lex)
    mask = sentences_hit("_sp", "_so") if sentence_level else F.transform(
        "_sp", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return X.held(d, out, mask).drop("_sp", "_so", "_ss")


def token_mask(offsets, mask) -> Column:
    """0/1 per token: 1 where the token's (start, end) overlaps a mask span."""
    return F.transform(offsets, lambda o: F.exists(
        X.as_col(mask), lambda s: (o["end"] > s["start"]) & (o["start"] < s["end"])).cast("int"))


def diagnose_pairs(pairs: DataFrame, lex, keep: Sequence[str], chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Differing-word share, off-feature share and length ratio per pair.

    Words differ that a shortest edit script deletes or inserts, wherever in the pair it edits. A differing word is on the
    feature when it meets a sentence that holds it. Where several shortest scripts exist, their counts agree; which of equal
    words counts as the one edited is settled from the ends of the texts inwards.
    """
    d = pairs.select(*keep, F.coalesce(chosen, F.lit("")).alias("_a"), F.coalesce(rejected, F.lit("")).alias("_b"))
    for t in ("_a", "_b"):
        d = feature_mask(d, t, lex, f"{t}m")
    d = X.held(d, "_d", differing("_a", "_b"))

    def off(words, mask):
        return F.size(F.filter(words, lambda w: ~F.exists(mask, lambda s: (w["end"] > s["start"]) & (w["start"] < s["end"]))))
    total = F.size("_d.a") + F.size("_d.b")
    share = F.when(total > 0, (off(F.col("_d.a"), F.col("_am")) + off(F.col("_d.b"), F.col("_bm"))) / total).otherwise(0.0)
    ratio = F.when(total == 0, F.lit(1.0)).when(F.col("_d.lb") > 0, F.col("_d.la") / F.col("_d.lb"))
    return d.select(*keep, F.when(total > 0, total / F.col("_d.words")).otherwise(0.0).alias("differing"), share.alias("off_feature"),
                    ratio.alias("length_ratio"))


def diagnose(diagnosed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Medians per set; minimal below 0.15 off-feature, a note when lengths differ by more than 15 %."""
    from ledgerloom.operators.ranks import many_quantiles

    out = many_quantiles(diagnosed, by, {c: {c: "median"} for c in ("differing", "off_feature", "length_ratio")})
    return out.select(*by, "n", "differing", "off_feature", "length_ratio", (F.col("off_feature") < 0.15).alias("minimal"),
                      (F.abs(F.col("length_ratio") - 1) > 0.15).alias("length_note"))


# ---------------------------------------------------------------- gates, rewards, selection of pairs

def pair_gates(pairs: DataFrame, chosen_families: str, lex, gate_lex, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Original and amended pass flags: two families chosen, none rejected, length ratio, and content overlap."""
    ratio = F.length(chosen) / F.greatest(F.length(rejected), F.lit(1))
    enough = F.size(chosen_families) >= 2
    old = enough & (X.total_count(rejected, lex) == 0) & ratio.between(0.8, 1.3)
    new = enough & (X.total_count(rejected, gate_lex) == 0) & ratio.between(0.8, 1.4) & (X.content_overlap(chosen, rejected) >= 0.35)
    return pairs.withColumn("length_ratio", ratio).withColumn("pass_original", old).withColumn("pass_amended", new)


def extreme_pairs(samples: DataFrame, key: str, label: str, text: str, lex, second, margin: float = 0.10,
                  lo: float = 0.8, hi: float = 1.4) -> DataFrame:
    """Best against worst sample per prompt and the first gate that fails: margin, ratio, second instrument.

    Heavy prompts want a high composite, light ones a low density; the aggregate keeps two rows per prompt.
    """
    scored = D.disposition(samples, text, lex, [key, label, text, "sample"])
    heavy = F.col(label) == "heavy"
    scored = scored.withColumn("_r", F.round(F.when(heavy, F.col("composite")).otherwise(-F.col("density")), 9))
    side = F.struct("_r", "sample", text)
    g = scored.groupBy(key, label).agg(F.min(side).alias("w"), F.max(side).alias("b"), F.count("*").alias("samples"))
    ratio = F.length(f"b.{text}") / F.greatest(F.length(f"w.{text}"), F.lit(1))
    db, dw = D.density(F.col(f"b.{text}"), second), D.density(F.col(f"w.{text}"), second)
    wrong = F.when(F.col(label) == "heavy", db < dw).otherwise(db > dw)
    gate = (F.when(F.col("b._r") - F.col("w._r") < margin, "margin").when(~ratio.between(lo, hi), "ratio")
            .when(wrong, "second instrument").otherwise("kept"))
    return g.select(key, label, "samples", F.col(f"b.{text}").alias("chosen"), F.col(f"w.{text}").alias("rejected"),
                    (F.col("b._r") - F.col("w._r")).alias("margin"), gate.alias("gate"))


# --- fixed values: bounds of the preservation reward ---
LENGTHS, COPY_CAP, COPY_FREE, COPY_SCALE, REPEAT_FLOOR = (1200, 8000), 0.35, 0.15, 0.20, 0.45
# --- end of fixed values ---


def preservation_reward(df: DataFrame, completion: str, sources: str, lex, keep: Sequence[str], lengths=LENGTHS) -> DataFrame:
    """Reward for keeping what the sources raised; -1 outside the length window, above the copy cap or below the
    self-repetition floor."""
    w = df.select(*keep, F.length(completion).alias("_n"), X.words(completion).alias("_a"), X.words(sources).alias("_b"),
                  (F.col(sources) != "").alias("_has"), X.families_mask(completion, lex).alias("_out"), X.families_mask(sources, lex).alias("_up"))
    g = w.select("*", X.ngrams(F.col("_a"), 8).alias("_g8"), X.ngrams(F.col("_b"), 8).alias("_s8"), X.ngrams(F.col("_a"), 5).alias("_g5"))
    over = F.when(F.col("_has"), F.size(F.array_intersect("_g8", "_s8")) / F.greatest(F.size("_g8"), F.lit(1))).otherwise(F.lit(0.0))
    rep = F.size("_g5") / F.greatest(F.size("_a") - 4, F.lit(1))
    raised = F.bit_count(F.when(F.col("_has"), F.col("_up")).otherwise(F.lit(0).cast("bigint")))
    g = g.select(*keep, "_n", over.alias("overlap"), rep.alias("distinct_ratio"), raised.alias("_raised"),
                 F.when(F.col("_has"), F.bit_count(F.col("_out").bitwiseAND(F.col("_up")))).otherwise(0).alias("_kept"),
                 F.when(F.col("_has"), F.bit_count(X.mask_minus("_out", "_up"))).otherwise(F.bit_count("_out")).alias("_extra"))
    bad = ~F.col("_n").between(*lengths) | (F.col("overlap") > COPY_CAP) | (F.col("distinct_ratio") < REPEAT_FLOOR)
    score = (F.col("_kept") / F.greatest(F.col("_raised"), F.lit(1)) - 0.5 * F.col("_extra") / 4.0
             - 0.5 * F.greatest(F.lit(0.0), F.col("overlap") - COPY_FREE) / COPY_SCALE)
    return g.select(*keep, "overlap", "distinct_ratio", F.when(bad, F.lit(-1.0)).otherwise(score).alias("reward"))


# ---------------------------------------------------------------- splits, sampling, requests

def _hash(seed, key) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in ([key] if isinstance(key, str) else key)]))


def ordered_ranks(df: DataFrame, order: str) -> DataFrame:
    """1-based rank by a hex hash column, by a tree of counts over its first 60 bits."""
    key = F.shiftleft(F.conv(F.substring(order, 1, 15), 16, 10).cast("bigint"), 3)
    return below(df.withColumn("_one", F.lit(1).cast("bigint")), [], key, ["_one"], [order]).withColumn(
        "rank", F.col("_one_below") + 1).drop("_one", "_one_below", "_one_all")


def split(pairs: DataFrame, key: str, seed: int = 42, share: int = 20, least: int = 4, cap: int | None = None) -> DataFrame:
    """valid, test and train by hashed order: a twentieth (at least four) each for valid and test, train optionally
    limited to a dose, beyond which rows are "unused"."""
    n = pairs.agg(F.count("*").alias("_n"))
    r = ordered_ranks(pairs.withColumn("_h", _hash(seed, key)), "_h").join(F.broadcast(n))
    k = F.greatest(F.lit(least), F.floor(F.col("_n") / share))
    part = F.when(F.col("rank") <= k, "valid").when(F.col("rank") <= 2 * k, "test").otherwise("train")
    r = r.withColumn("split", part)
    if cap is not None:
        r = r.withColumn("split", F.when((F.col("split") == "train") & (F.col("rank") > 2 * k + cap), "unused").otherwise(F.col("split")))
    return r.drop("_h", "_n", "rank")


def dose_match(pairs: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each group as the smallest one has, by hashed order of the key, so that arms differ in kind and not in
    dose. A null group is a group. Ranks are taken over a tree on the hash, so that a hot group is no single task's.

    key  tells the rows of a group apart
    """
    least = pairs.groupBy(by).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_dose"))
    rows = pairs.withColumns({"_h": _hash(seed, key), "_one": F.lit(1).cast("bigint")})
    code = F.shiftleft(F.conv(F.substring("_h", 1, 15), 16, 10).cast("bigint"), 3)
    placed = below(rows, [by], code, ["_one"], ["_h", key]).join(F.broadcast(least))
    return placed.where(F.col("_one_below") < F.col("_dose")).select(*pairs.columns)


def dedup(df: DataFrame, key: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row (in a stated order) per key hash, by a map-side-combined struct minimum."""
    return df.groupBy(F.md5(key).alias("digest")).agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("_r"), F.count("*").alias("copies")).select("_r.*", "copies")


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str], results: Sequence[str] | None = None) -> DataFrame:
    """Work not yet done. A row of `done` counts when one of its results is not null; work without a key is always due.

    results  result columns, by default all columns of `done` but the keys; without any, every row counts
    """
    found = [c for c in done.columns if c not in keys] if results is None else list(results)
    if found:
        done = done.where(F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in found], F.lit(False)))
    return work.join(done.select(*keys), list(keys), "left_anti")


def prompt_pool(topics: DataFrame, templates: dict[str, str], topic: str) -> DataFrame:
    """Every topic rendered into every template ({} marks the place)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("t")) for k, v in templates.items()]))
    rows = topics.select(topic, each.alias("e"))
    return rows.select(topic, "e.template", F.replace(F.col("e.t"), F.lit("{}"), F.col(topic)).alias("prompt"))


def stratified(df: DataFrame, key: str, strata: dict[str, Column], n: int = 50, seed: int = 0) -> DataFrame:
    """Overlapping strata filled in order, n each, no unit twice: per stratum a top-n by hash of what is left."""
    left, picked = df.withColumn("_h", _hash(seed, key)), None
    for name, cond in strata.items():
        take = left.where(cond).orderBy("_h").limit(n).withColumn("stratum", F.lit(name))
        picked = take if picked is None else picked.unionByName(take)
        left = left.join(take.select(key), key, "left_anti")
    return picked.drop("_h")


def subsample(df: DataFrame, by: str, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n units per group by hashed order (group-limited, so a hot group costs n rows per task)."""
    r = F.row_number().over(Window.partitionBy(by).orderBy("_h"))
    return df.withColumn("_h", _hash(seed, key)).withColumn("_r", r).where(F.col("_r") <= n).drop("_h", "_r")


def build_arms(items: DataFrame, sources: DataFrame, item: str, case: str, arms: dict[str, Column], repeats: int, header: str) -> DataFrame:
    """Items x arms x repeats with their upstream text: each source's base text plus the arm's addition.

    arms     name -> text to append to a source, an expression over item columns and `seat` (null: nothing)
    sources  case, seat, text
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), e.alias("add")) for a, e in arms.items()]))
    rows = items.join(sources, case).select(item, case, "seat", "text", each.alias("e"))
    part = F.concat(F.lit(header), F.regexp_replace("text", r"\s+$", ""), F.coalesce(F.concat(F.lit("\n\n"), "e.add"), F.lit("")))
    # as many parts as the case has seats
    built = rows.groupBy(item, case, "e.arm").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seat", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("upstream"),
        F.min(F.when(F.col("e.add").isNotNull(), F.col("seat"))).alias("treated"))
    return built.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def judge_requests(units: DataFrame, unit: str, sentences: str, judges: Sequence[str], batch: int = 10) -> DataFrame:
    """One row per judge and batch of numbered sentences, batches running over all units in order."""
    from ledgerloom.sources.ledger import global_offsets

    placed = global_offsets(units, unit, F.size(sentences))
    s = X.explode_rows(placed, ["offset"], F.col(sentences), "_i", "_s").select((F.col("offset") + F.col("_i")).alias("_g"), "_s")
    s = s.withColumn("start", (F.floor(F.col("_g") / batch) * batch))
    # a batch never holds more than `batch` sentences
    b = s.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("_g", "_s"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["_s"])), "\n")
    return b.select("start", F.size("_l").alias("n"), body.alias("body"), F.explode(F.array(*[F.lit(j) for j in judges])).alias("judge"))


# --- fixed values: how a pair is laid before a judge ---
PAIR_HEADS = ("Question:\n", "\n\n--- Response A ---\n", "\n\n--- Response B ---\n")
# --- end of fixed values ---


def pair_requests(pairs: DataFrame, key: str, judges: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """Every pair before every judge in both orderings: key, judge, ordering (fwd, rev) and body; what has a verdict is left out.

    A null verdict is a failed call and is asked again. The verdicts of a pair are folded to at most two a judge before they meet
    it, so texts cross one shuffle and are copied only into requests that are due. Null texts are empty; a pair without a key is
    always due.

    pairs  key, question, first, second (keys tell pairs apart)      done  key, judge, ordering, verdict
    """
    wanted = [(j, o) for j in judges for o in ("fwd", "rev")]
    slots = F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(o).alias("ordering"), F.lit(1 << i).cast("bigint").alias("bit"))
                      for i, (j, o) in enumerate(wanted)])
    due = pairs.withColumn("_seen", F.lit(0).cast("bigint"))
    if done is not None:
        bits = [F.max(F.when((F.col("judge") == j) & (F.col("ordering") == o), F.lit(1 << i)).otherwise(0)).cast("bigint")
                for i, (j, o) in enumerate(wanted)]
        seen = done.where(F.col("verdict").isNotNull()).groupBy(key).agg(reduce(lambda x, y: x + y, bits).alias("_seen"))
        due = pairs.join(seen, key, "left").withColumn("_seen", F.coalesce("_seen", F.lit(0).cast("bigint")))
    left = F.filter(slots, lambda s: F.col("_seen").bitwiseAND(s["bit"]) == 0)
    rows = due.select(key, "question", "first", "second", F.explode(left).alias("s"))
    x, y = F.coalesce("first", F.lit("")), F.coalesce("second", F.lit(""))
    fwd = F.col("s.ordering") == "fwd"
    q, one, two = (F.lit(h) for h in PAIR_HEADS)
    body = F.concat(q, F.coalesce("question", F.lit("")), one, F.when(fwd, x).otherwise(y), two, F.when(fwd, y).otherwise(x))
    return rows.select(key, "s.judge", "s.ordering", body.alias("body"))


def property_order(key, names: Sequence[str], seed: int = 42) -> Column:
    """The properties in an order of each unit's own, by hash of seed, key and name, against position bias."""
    marked = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(X.as_col(key).cast("string"), F.lit("~")), n)).alias("h"), n.alias("n")))
    return F.transform(F.sort_array(marked), lambda e: e["n"])


def property_requests(units: DataFrame, key: str, definitions: dict[str, str], done: DataFrame | None = None,
                      results: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """One request per unit not yet done: its key, the properties in its own order, and their definitions line by line."""
    due = units if done is None else remaining(units, done, [key], results)
    table = F.create_map(*[F.lit(x) for kv in definitions.items() for x in kv])
    lines = F.transform(F.col("properties"), lambda n: F.concat(F.lit("- "), n, F.lit(": "), F.element_at(table, n)))
    return due.withColumn("properties", property_order(key, list(definitions), seed)).withColumn("definitions", F.array_join(lines, "\n"))
