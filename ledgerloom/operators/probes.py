"""Known-value checks on outputs: adoption, propagation, accuracy, form tracking, carriage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions import text as X


def contains_any(text: Column, probes, rule: str) -> Column:
    """Some probe of the array occurs in the (already normalised) text, which is computed once."""
    return X.let(text, lambda t: F.exists(X.as_col(probes), lambda p: F.contains(t, X.norm(p, rule))))


def adoption(runs: DataFrame, right: str, wrong: str, arm: str, output: str = "output", rule: str = "money",
             split: str = "three_way") -> DataFrame:
    """Adoption counts per arm.

    three_way  correct (right and not wrong), corrupted (wrong), neither
    four_way   clean only, wrong only, both, neither
    """
    flags = runs.withColumn("_o", X.norm(output, rule)).select(
        arm, contains_any(F.col("_o"), right, rule).alias("r"), contains_any(F.col("_o"), wrong, rule).alias("w"))
    r, w = F.col("r"), F.col("w")
    if split == "three_way":
        parts = {"correct": r & ~w, "corrupted": w, "neither": ~r & ~w}
    else:
        parts = {"clean": r & ~w, "wrong": w & ~r, "both": r & w, "neither": ~r & ~w}
    return flags.groupBy(arm).agg(
        F.count("*").alias("n"), *[F.count_if(e).alias(k) for k, e in parts.items()],
        S.ratio(F.count_if(r & ~w), F.count_if(r != w)).alias("decisive_share"))


def propagation(asserts: DataFrame, run: str, judges: Sequence[str], injections: DataFrame, min_n: int = 10) -> DataFrame:
    """Per arm and error type: runs in which all judges assert the planted claim, exact matches, attribution.

    asserts     run, judge, asserts, specialist (null = unparseable)
    injections  run, arm, kind, injected_index, exact (literal containment)
    """
    per = asserts.groupBy(run).agg(
        F.count_if(F.col("asserts").isNotNull()).alias("_n"), F.every("asserts").alias("_all"),
        F.count_if(F.col("specialist").isNotNull()).alias("_s"), F.min("specialist").alias("_lo"), F.max("specialist").alias("_hi"))
    j = injections.join(per, run, "left")
    judged = F.col("_n") == len(judges)
    prop = judged & F.col("_all")
    named = prop & (F.col("_s") == len(judges))
    right = named & (F.col("_lo") == F.col("_hi")) & (F.col("_lo") == F.col("injected_index"))
    g = j.groupBy("arm", "kind").agg(
        F.count("*").alias("runs"), F.count_if(judged).alias("judged"), F.count_if(prop).alias("propagated"),
        F.count_if("exact").alias("exact"), F.count_if(named).alias("attributable"), F.count_if(right).alias("attributed"))
    lo, hi = S.wilson("propagated", "judged")
    return g.select("*", S.ratio("propagated", "judged").alias("rate"), lo.alias("rate_lo"), hi.alias("rate_hi"),
                    F.when(F.col("attributable") >= min_n, S.ratio("attributed", "attributable")).alias("attribution"))


def accuracy(runs: DataFrame, forms: str, by: Sequence[str], output: str = "output") -> DataFrame:
    """Accepted form in the answer line, or in the full text where there is no line (counted as fallback)."""
    line = X.answer_line(output)
    s = runs.select(*by, forms, line.alias("_l"), F.col(output).alias("_o"))
    hay = X.norm(F.coalesce("_l", "_o"), "amount")
    s = s.withColumn("_h", hay).select(*by, contains_any(F.col("_h"), forms, "amount").alias("c"), F.col("_l").isNotNull().alias("a"))
    g = s.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("c").alias("correct"), F.count_if("a").alias("attempted"),
                           F.count_if(F.col("c") & ~F.col("a")).alias("fallback"))
    lo, hi = S.wilson("correct", "n")
    return g.select("*", S.ratio("correct", "n").alias("accuracy"), lo.alias("lo"), hi.alias("hi"))


def form_tracking(sentences: DataFrame, run: str, arm: str, sentence: str, both_agree: str, forms: dict[str, str]) -> DataFrame:
    """Per run: does each form occur, is the construct there at all, is it there outside each form?"""
    low = F.lower(X.as_col(sentence))
    return sentences.groupBy(run, arm).agg(
        F.bool_or(both_agree).alias("construct"),
        *[F.bool_or(F.contains(low, F.lit(v.lower()))).alias(f"has_{k}") for k, v in forms.items()],
        *[F.bool_or(F.col(both_agree) & ~F.contains(low, F.lit(v.lower()))).alias(f"without_{k}") for k, v in forms.items()])


def tension_named(text, domain, keys) -> Column:
    """Some line mentions the route domain and one of the topic keys (case-folded)."""
    lines = F.split(F.lower(X.strip_thinking(text, unopened=False)), "\n", -1)
    return F.exists(lines, lambda ln: F.contains(ln, X.as_col(domain)) & F.exists(X.as_col(keys), lambda k: F.contains(ln, k)))


def carriage(runs: DataFrame, caveats: DataFrame, case: str, output: str = "output") -> DataFrame:
    """Share of a case's caveats literally present in the bare output and in output plus appendix.

    caveats  case, variant, sentences: the variant with most sentences is used, the first on ties
    """
    best = caveats.groupBy(case).agg(F.max_by("sentences", F.struct(F.size("sentences"), -F.col("variant"))).alias("_c"))
    def flat(t):
        return F.lower(F.regexp_replace(F.translate(t, "*", ""), r"(?U)\s+", " "))
    # a case's caveats and appendix are normalised once and not with every output
    app = flat(F.concat(F.lit("\n\n---\n"), F.array_join(F.transform("_c", lambda s: F.concat(F.lit("- "), X.strip(s))), "\n")))
    best = best.where(F.size("_c") > 0).select(case, F.size("_c").alias("_n"), F.transform("_c", lambda s: flat(X.strip(s))).alias("_s"), app.alias("_a"))
    best = best.select(case, "_n", "_a", F.transform("_s", lambda s: F.struct(s.alias("s"), F.contains("_a", s).alias("in"))).alias("_s"))
    j = runs.join(best, case).select(case, "_n", "_s", "_a", flat(F.col(output)).alias("_b"))

    def held(body, of):
        return X.let(body, lambda b: F.size(F.filter("_s", lambda e: b.isNotNull() & of(b, e))))
    # blanks meet where the appendix begins; what it holds by itself needs no search in the whole
    whole = F.concat(F.rtrim("_b"), F.col("_a"))
    j = j.select(case, "_n", held(F.col("_b"), lambda b, e: F.contains(b, e["s"])).alias("_bare"),
                 held(whole, lambda b, e: e["in"] | F.contains(b, e["s"])).alias("_full"))
    return j.groupBy(case).agg(
        F.count("*").alias("runs"), F.sum("_n").alias("caveats"), F.sum("_bare").alias("carried_bare"),
        F.sum("_full").alias("carried_appendix")).select(
        "*", S.ratio("carried_bare", "caveats").alias("share_bare"), S.ratio("carried_appendix", "caveats").alias("share_appendix"))
