"""System-level reports: blind spots, power, screens, summaries, parameter cards and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions import text as X
from ledgerloom.functions.groups import join_groups
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import detection as D
from ledgerloom.operators import estimators as E
from ledgerloom.operators import hygiene as P
from ledgerloom.operators import provenance as V
from ledgerloom.operators import ranks as R


def blindspot(probes: DataFrame, instruments: dict[str, str]) -> DataFrame:
    """Miss rate per instrument on labelled probes, from masks counted once.

    probes  truth_mask, and one mask column per instrument (name -> column)
    """
    cols = list(instruments.values())
    m = probes.groupBy("truth_mask", *cols).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("instrument"), F.bit_count(X.mask_minus("truth_mask", col)).cast("bigint").alias("miss"),
                 F.bit_count("truth_mask").cast("bigint").alias("total")) for name, col in instruments.items()]))
    g = m.select(each.alias("e"), "n").groupBy("e.instrument").agg(
        F.sum(F.col("e.miss") * F.col("n")).alias("missed"), F.sum(F.col("e.total") * F.col("n")).alias("total"))
    lo, hi = S.wilson("missed", "total")
    return g.select("*", S.ratio("missed", "total").alias("miss_rate"), lo.alias("lo"), hi.alias("hi"))


def joint_miss(misses: DataFrame) -> DataFrame:
    """Product of the miss rates (zero when any is zero), an upper bound on ensemble strength."""
    return misses.agg(F.count("*").alias("instruments"), F.when(F.min("miss_rate") > 0, F.exp(F.sum(F.log(
        F.when(F.col("miss_rate") > 0, F.col("miss_rate")))))).otherwise(F.lit(0.0)).alias("joint"))


def disagreement(probes: DataFrame, instruments: dict[str, str]) -> DataFrame:
    """|A xor B| / |A or B| of detections per instrument pair, near-duplicates flagged below 0.1."""
    names = sorted(instruments)
    m = probes.groupBy(*instruments.values()).agg(F.count("*").alias("n"))
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 F.bit_count(F.col(instruments[a]).bitwiseXOR(F.col(instruments[b]))).cast("bigint").alias("d"),
                 F.bit_count(F.col(instruments[a]).bitwiseOR(F.col(instruments[b]))).cast("bigint").alias("u"))
        for i, a in enumerate(names) for b in names[i + 1:]]
    g = m.select(F.explode(F.array(*rows)).alias("e"), "n").groupBy("e.a", "e.b").agg(
        F.sum(F.col("e.d") * F.col("n")).alias("differ"), F.sum(F.col("e.u") * F.col("n")).alias("union"))
    r = S.ratio("differ", "union")
    return g.select("*", r.alias("disagreement"), (r < 0.1).alias("near_duplicate"))


def spearman(table: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of a table of group means, average ranks on ties."""
    return R.spearman(table, x, y)


def retention(turns: DataFrame, finals: DataFrame, lex) -> DataFrame:
    """Final density over owner-seat density per family; null below 0.01."""
    fd = D.family_density(turns, lex)
    top = fd.withColumn("_d", F.round("density", 9)).groupBy("family").agg(
        F.min(F.struct((-F.col("_d")).alias("d"), "seat")).alias("b"))
    fin = D.family_density(finals.withColumn("seat", F.lit("final")), lex).select("family", F.col("density").alias("final_density"))
    own = top.select("family", F.col("b.seat").alias("owner"), (-F.col("b.d")).alias("owner_density"))
    return own.join(fin, "family").select("*", F.when(F.col("owner_density") > 0.01, F.col("final_density") / F.col("owner_density")).alias("retention"))


# --- fixed values: normal quantiles of a two-sided 5 % test at 80 % power ---
Z_ALPHA, Z_POWER = 1.959964, 0.8416212
# --- end of fixed values ---


def power(df: DataFrame, arm: str, a: str, b: str, value: str) -> DataFrame:
    """Cohen's d of two arms and the runs per arm for 80 % power."""
    on = lambda w: F.when(F.col(arm) == w, F.col(value))
    g = df.agg(F.avg(on(a)).alias("mean_a"), F.avg(on(b)).alias("mean_b"), F.var_samp(on(a)).alias("va"), F.var_samp(on(b)).alias("vb"))
    sd = F.sqrt((F.col("va") + F.col("vb")) / 2)
    d = F.when(sd > 0, F.abs(F.col("mean_a") - F.col("mean_b")) / sd)
    return g.select("mean_a", "mean_b", d.alias("d"), F.when(d > 0, F.ceil(2 * (Z_ALPHA + Z_POWER) ** 2 / (d * d))).alias("n_per_arm"))


def effective_n(df: DataFrame, by: Sequence[str], cluster: str, icc: float = 0.190) -> DataFrame:
    """Design effect 1 + (m - 1) ICC and the effective number of runs."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(cluster).alias("clusters"))
    de = 1 + (F.col("n") / F.greatest("clusters", F.lit(1)) - 1) * icc
    return g.select("*", de.alias("design_effect"), (F.col("n") / de).alias("n_eff"))


def degeneracy(runs: DataFrame, producer: str, text: str, min_chars: int = 800) -> DataFrame:
    """Producers most of whose runs are too short to measure."""
    return runs.groupBy(producer).agg(F.count("*").alias("n"), F.count_if(F.length(text) < min_chars).alias("short")).withColumn(
        "dropped", F.col("short") > F.col("n") / 2)


def drop_degenerate(runs: DataFrame, producer: str, text: str, min_chars: int = 800) -> DataFrame:
    dead = degeneracy(runs, producer, text, min_chars).where("dropped").select(producer)
    return runs.join(dead, producer, "left_anti")


def lineage(runs: DataFrame, tuned_of: dict[str, tuple[str, str]], case: str, producer: str, domain: str, value: str,
            inside: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Tuned minus own base per lineage, in domain with a case bootstrap and off domain, with signs.

    tuned_of  tuned producer -> (base producer, lineage)
    """
    rows = [F.struct(F.lit(t).alias("tuned"), F.lit(b).alias("base"), F.lit(f).alias("family")) for t, (b, f) in tuned_of.items()]
    # each run belongs to the few comparisons its producer takes part in; they are listed in the row
    part = F.filter(F.array(*rows), lambda e: (F.col(producer) == e["tuned"]) | (F.col(producer) == e["base"]))
    long = runs.select(case, producer, domain, value, F.explode_outer(part).alias("e")).where("e is not null").select(
        case, domain, value, "e.*", F.when(F.col(producer) == F.col("e.tuned"), "tuned").otherwise("base").alias("role"))
    ind = long.where(F.col(domain) == inside)
    ci = E.cluster_difference(ind, case, "role", "tuned", "base", value, by=["family", "tuned"], draws=draws, seed=seed)
    def mean(role, dom):
        return F.avg(F.when((F.col("role") == role) & dom, F.col(value)))
    ins = F.col(domain) == inside
    off = long.groupBy("family", "tuned").agg((mean("tuned", ~ins) - mean("base", ~ins)).alias("delta_off"))
    sign = F.when(F.col("diff_lo") > 0, "positive").when(F.col("diff_hi") < 0, "negative").otherwise("spans zero")
    return ci.join(off, ["family", "tuned"]).select(
        "family", "tuned", F.col("diff").alias("delta_in"), "diff_lo", "diff_hi", "delta_off", sign.alias("sign"),
        (F.abs("diff") > 2 * F.abs("delta_off")).alias("domain_specific"))


def lineage_verdict(deltas: DataFrame) -> DataFrame:
    """Replicated when at least two lineages exist and all of them are positive throughout."""
    per = deltas.groupBy("family").agg(F.every(F.col("sign") == "positive").alias("pos"), F.every(F.col("sign") == "negative").alias("neg"))
    return per.agg(F.count("*").alias("lineages"), F.count_if("pos").alias("positive"), F.count_if("neg").alias("negative")).withColumn(
        "verdict", F.when(F.col("lineages") < 2, "not evaluable").when(F.col("positive") == F.col("lineages"), "replicated")
        .when(F.col("negative") == F.col("lineages"), "replicated negative").otherwise("not replicated"))


def silence(audited: DataFrame, by: Sequence[str], sentences: str | None = None) -> DataFrame:
    """What stands beside every rate: mean length, emitted, zero-output runs, floor violations."""
    return audited.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("chars").alias("mean_chars"), F.avg("emitted").alias("mean_emitted"),
        F.count_if(F.col("emitted") == 0).alias("silent"), F.avg(F.col("floor_guard").cast("int")).alias("floor_rate"),
        *([F.avg(sentences).alias("mean_sentences")] if sentences else []))


def mode_summary(calls: DataFrame, by: Sequence[str], latency: str, size: str, tokens: str, failed: str) -> DataFrame:
    """Latency, size and tokens per case and mode; completed and failed."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(~F.col(failed)).alias("completed"), F.count_if(F.col(failed)).alias("failed"),
        F.sum(latency).alias("latency"), F.avg(size).alias("mean_size"), F.sum(tokens).alias("tokens"))


def parameter_cards(runs: DataFrame, lex, by: str = "condition", draws: int = 2000) -> DataFrame:
    """One row per system: usable and dropped runs, shrinkage with guards, clean rate, span fraction."""
    usable, _ = P.partition(runs)
    fine = P.first_fatal(P.problems()).isNull()
    counts = runs.select(by, fine.alias("_ok")).groupBy(by).agg(F.count("*").alias("supplied"), F.count_if("_ok").alias("used"))
    a = E.precount(V.audit(usable, lex), [by])
    sh = E.shrinkage(a, [by], families=len(lexicon(lex)), draws=draws)
    cl = E.clean_rate(a, [by]).select(by, "p0", "lam", "worst_supply", "p_worst")
    need = E.draws_needed(a, [by])
    sp = E.span_fraction(usable, lex, [by]).select(by, "f_median", "dilution")
    out = counts
    for part in (sh, cl, need, sp):
        out = join_groups(out, part, [by], "left")
    return out.select(by, "supplied", "used", "w", "w_lo", "w_hi", "c", "c_lo", "c_hi",
                      F.coalesce("verdict", F.lit("no usable records")).alias("verdict"), F.coalesce("identifiable", F.lit(False)).alias("identifiable"),
                      "p0", "lam", "worst_supply", "p_worst", "n_needed", "basis", "f_median", "dilution")


def recommend(cards: DataFrame, white_box: bool = False, can_train: bool = False, rl_infra: bool = False) -> DataFrame:
    """Decision rule over card columns, as an ordered list of codes."""
    faithful = F.coalesce(F.col("identifiable") & (F.col("w") >= 0.85) & (F.col("c") <= 0.15), F.lit(False))
    rules = [
        F.when(faithful, "no intervention"),
        F.when(~faithful & (F.col("n_needed") > 0), F.concat(F.lit("best of "), F.col("n_needed").cast("string"))),
        F.when(~faithful & (F.col("n_needed") < 0), "selection insufficient"),
        F.when(~faithful & F.lit(can_train) & (F.col("f_median") < 0.5), "minimal pairs with masked loss"),
        F.when(~faithful & F.lit(can_train), "counterfactual corpus"),
        F.when(~faithful, "steering available" if white_box else "steering unavailable"),
        F.when(~faithful & F.lit(rl_infra), "ensemble reward last"),
    ]
    return cards.withColumn("recommendations", F.array_compact(F.array(*rules)))


def selftest(cards: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Each listed card column inside its published range: ok, out of range or missing."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
        for c, (lo, hi) in bounds.items()]))
    keep = [c for c in cards.columns if c not in bounds][:1]
    return cards.select(*keep, rows.alias("e")).select(*keep, "e.*").withColumn(
        "status", F.when(F.col("value").isNull(), "missing").when(F.col("value").between(F.col("lo"), F.col("hi")), "ok").otherwise("out of range"))


def ledger_report(runs: DataFrame, first_turn: str, lex, keep: Sequence[str]) -> DataFrame:
    """Per run: length, density, composite, density of one seat's first turn, 180-character excerpt."""
    base = D.disposition(runs.withColumn("_chars", F.length("output")), "output", lex, [*keep, "_chars", first_turn, "output"])
    return base.select(*keep, F.col("_chars").alias("chars"), "density", "composite",
                       F.when(F.col(first_turn) != "", D.density(first_turn, lex)).alias("seat_density"),
                       F.translate(F.substring("output", 1, 180), "\n|", " /").alias("excerpt"))


def gate_density(turns: DataFrame, lex, by: Sequence[str], trigger_free: str, text: str = "text") -> DataFrame:
    """Mean density on trigger-free cases (a missing turn counts 0 there) against the other cases."""
    d = F.when(F.col(text).isNotNull(), D.density(text, lex))
    gate = F.when(F.col(trigger_free), F.coalesce(d, F.lit(0.0)))
    seat = F.when(~F.col(trigger_free), d)
    return turns.groupBy(*by).agg(F.count_if(F.col(trigger_free)).alias("gate_runs"), F.avg(gate).alias("gate_density"),
                                  F.count(seat).alias("seat_runs"), F.avg(seat).alias("seat_density"))


def gate(rates: DataFrame, bars: dict[str, tuple[str, float]]) -> DataFrame:
    """Observed rates against registered bars: bars maps metric -> (op, bar) with op >= or <."""
    table = [F.struct(F.lit(k).alias("metric"), F.lit(op).alias("op"), F.lit(float(b)).alias("bar")) for k, (op, b) in bars.items()]
    b = F.filter(F.array(*table), lambda e: e["metric"] == F.col("metric"))
    r = rates.withColumn("_b", F.get(b, F.lit(0))).where(F.col("_b").isNotNull())
    hit = F.when(F.col("_b.op") == ">=", F.col("rate") >= F.col("_b.bar")).otherwise(F.col("rate") < F.col("_b.bar"))
    return r.select(*rates.columns, F.col("_b.bar").alias("bar"), F.when(F.col("rate").isNull(), "not evaluable").when(hit, "proceed").otherwise("stop").alias("decision"))
