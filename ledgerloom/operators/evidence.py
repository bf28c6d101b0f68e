"""What invented families rest on: phrases with an excerpt, feedback for a rewrite, and two detectors side by side.

Phrases are looked up only for families that an output invented, in the row that holds it; texts never cross a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon
from ledgerloom.operators.provenance import MIN_OUTPUT_CHARS, audit, join_upstream

# --- fixed values: what families are called towards a writer, feedback and annotation texts ---
DESCRIBED = {
    "cutoff": "training-cutoff / recency disclaimers",
    "modeled": "assumption or modeling language",
    "jurisd": "jurisdictional or regime distinctions",
    "hedging": "hedging or variability qualifiers",
}
FEEDBACK_HEAD = "REVISION REQUIRED. Your draft introduced the following qualifications that NO specialist raised:"
FEEDBACK_TAIL = "Remove each of these, or ground it by explicitly attributing it to a specific specialist's contribution. " \
    "Do not add new qualifications. Keep everything else, including qualifications the specialists DID raise, exactly as supported."
ANNOTATION_HEAD = "\n\n---\n*Provenance note: this answer contains "
ANNOTATION_TAIL = " that no consulted specialist raised; treat those passages as the synthesizer's own framing rather than " \
    "specialist input.*"
# --- end of fixed values ---


def flagged(runs: DataFrame, lex="epistemic", floor: int = MIN_OUTPUT_CHARS, shown: int = 4, width: int = 400) -> DataFrame:
    """One row per run and invented family: its first phrases, and the first sentence of the output that holds one.

    All phrases kept as evidence (five a family) may place the excerpt, letter case aside; without such a sentence it is empty.
    Outputs under the floor, and null ones, flag nothing.

    runs  run_id, upstream, output
    """
    found = audit(runs.withColumn("_text", F.col("output")), lex, floor, evidence=True)

    def place(sentences, phrases):
        held = F.filter(sentences, lambda s: X.let(F.lower(s), lambda low: F.exists(phrases, lambda p: F.contains(low, F.lower(p)))))
        return F.substring(F.coalesce(F.get(held, F.lit(0)), F.lit("")), 1, width)

    items = X.let(X.sentences("_text", "quoted"), lambda ss: F.transform(F.map_entries("evidence"), lambda e: F.struct(
        e["key"].alias("family"), F.slice(e["value"], 1, shown).alias("phrases"), place(ss, e["value"]).alias("excerpt"))))
    return X.explode_rows(found, ["run_id"], items, "_at", "_e").select("run_id", "_e.*")


def _named(family: Column, described: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in described.items() for x in kv])
    return F.coalesce(F.try_element_at(table, family), family)


def feedback(evidence, described: Mapping[str, str] | None = None, shown: int = 3) -> Column:
    """The request to revise that names every invented family with its first phrases; null where there is none.

    evidence  map of family to phrases
    """
    lines = F.transform(F.sort_array(F.map_entries(X.as_col(evidence))), lambda e: F.concat(
        F.lit("- "), _named(e["key"], described or DESCRIBED), F.lit(": "),
        F.array_join(F.transform(F.slice(e["value"], 1, shown), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", ")))
    return X.let(lines, lambda ls: F.when(F.size(ls) > 0, F.concat_ws("\n", F.lit(FEEDBACK_HEAD), ls, F.lit(FEEDBACK_TAIL))))


def annotation(residual, lex="epistemic", described: Mapping[str, str] | None = None) -> Column:
    """The note under an answer whose inventions no retry removed; null where nothing is left."""
    names = F.transform(X.mask_names(residual, lex), lambda f: _named(f, described or DESCRIBED))
    return X.let(names, lambda ns: F.when(F.size(ns) > 0, F.concat(F.lit(ANNOTATION_HEAD), F.array_join(ns, ", "), F.lit(ANNOTATION_TAIL))))


def feedback_sent(attempts: DataFrame, lex="epistemic", max_retries: int = 2, floor: int = MIN_OUTPUT_CHARS,
                  described: Mapping[str, str] | None = None) -> DataFrame:
    """The feedback of every attempt that was answered by another one: run_id, attempt, feedback.

    An attempt is answered if it invents something, none before it was clean, and a later one within the budget is stored.

    attempts  run_id, attempt (0 the draft), upstream, output
    """
    a = audit(attempts.where(F.col("attempt") <= max_retries), lex, floor, evidence=True).select(
        "run_id", "attempt", F.col("n_invented").alias("_n"), feedback("evidence", described).alias("feedback"))
    run = Window.partitionBy("run_id")
    a = a.withColumns({"_ok": F.min(F.when(F.col("_n") == 0, F.col("attempt"))).over(run), "_last": F.max("attempt").over(run)})
    sent = (F.col("_n") > 0) & (F.col("attempt") < F.col("_last")) & (F.col("_ok").isNull() | (F.col("attempt") < F.col("_ok")))
    return a.where(sent).select("run_id", "attempt", "feedback")


def _two(runs: DataFrame, lex_a, lex_b, floor: int) -> DataFrame:
    """Runs counted by what each of two detectors finds raised and invented (ra, ia, rb, ib, n)."""
    if list(lexicon(lex_a)) != list(lexicon(lex_b)):
        raise ValueError("the two lexicons must name the same families in the same order")
    up, out = join_upstream("upstream"), F.col("output")
    found = runs.select(F.length("output").alias("chars"), *[
        X.families_mask(text, lex).alias(f"{what}{side}") for side, lex in (("a", lex_a), ("b", lex_b))
        for what, text in (("r", up), ("p", out))])
    # a null output counts as a short one
    invented = [F.when(F.col("chars") >= floor, X.mask_minus(f"p{s}", f"r{s}")).otherwise(F.lit(0).cast("bigint")).alias(f"i{s}") for s in "ab"]
    return found.select("ra", "rb", *invented).groupBy("ra", "ia", "rb", "ib").agg(F.count("*").alias("n"))


def run_divergence(runs: DataFrame, lex_a, lex_b, floor: int = MIN_OUTPUT_CHARS) -> DataFrame:
    """Do two detectors agree that a run invented anything at all, and do they ever flag the same family? One row."""
    a, b = F.col("ia") != 0, F.col("ib") != 0

    def tally(cond, name):
        return F.coalesce(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.lit(0)).alias(name)
    t = _two(runs, lex_a, lex_b, floor).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), tally(a & b, "both"), tally(a & ~b, "only_a"), tally(~a & b, "only_b"),
        tally(~a & ~b, "neither"), tally(F.col("ia").bitwiseAND(F.col("ib")) != 0, "same_family"))
    return t.withColumn("divergence", F.when(F.col("runs") > 0, (F.col("only_a") + F.col("only_b")) / F.col("runs")))


def supply_histograms(runs: DataFrame, lex_a, lex_b) -> DataFrame:
    """Runs per supply as each of two detectors sees it: supply, runs_a, runs_b; values that neither sees have no row."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.bit_count(f"r{s}").alias("supply")) for s in "ab"]))
    long = _two(runs, lex_a, lex_b, 0).select(each.alias("e"), "n").select("e.*", "n")
    return long.groupBy("supply").agg(*[
        F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"runs_{s}") for s in "ab"])
