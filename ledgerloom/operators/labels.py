"""Judge replies, agreement and preference verdicts. Unparseable is null and never a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions.groups import join_groups
from ledgerloom.functions.text import let
from ledgerloom.functions import text as X
from ledgerloom.operators import ranks as R

# ---------------------------------------------------------------- reply decoding


def _object(reply) -> Column:
    """The outermost {...} of a reply without its paired reasoning blocks, as a variant; null if not JSON."""
    body = F.regexp_extract(X.strip_thinking(reply, unopened=False), r"(?s)\{.*\}", 0)
    return F.try_parse_json(F.nullif(body, F.lit("")))


def _boolean(v: Column, path: str) -> Column:
    """A JSON boolean at a path; anything else, also the string "true", is null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def decode_booleans(reply, keys: Sequence[str]) -> Column:
    """Map key -> boolean; null unless every key carries a JSON boolean. Accepts a "labels" wrapper."""
    v = _object(reply)
    inner = F.try_variant_get(v, "$.labels", "variant")
    root = F.coalesce(inner, v)
    vals = [_boolean(root, f"$.{k}") for k in keys]
    ok = vals[0].isNotNull()
    for x in vals[1:]:
        ok = ok & x.isNotNull()
    return F.when(ok, F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*vals)))


def decode_batch(reply, n: int, families: Sequence[str]) -> Column:
    """Array of n maps family -> boolean for replies keyed "1".."n"; null unless complete."""
    v = _object(reply)
    rows, ok = [], None
    for i in range(1, n + 1):
        vals = [_boolean(v, f"$['{i}'].{f}") for f in families]
        for x in vals:
            ok = x.isNotNull() if ok is None else ok & x.isNotNull()
        rows.append(F.map_from_arrays(F.array(*[F.lit(f) for f in families]), F.array(*vals)))
    return F.when(ok, F.array(*rows))


def decode_winner(reply) -> Column:
    """Last WINNER: A or B; else a single A or B on the last line; else null."""
    t = F.upper(X.strip_thinking(reply))
    named = F.regexp_extract_all(t, F.lit(r"WINNER:\s*([AB])\b"), F.lit(1))
    last = F.element_at(F.split(X.strip(t), "\n", -1), -1)
    a, b = last.rlike(r"\bA\b"), last.rlike(r"\bB\b")
    blank = F.coalesce(X.strip(reply) == "", F.lit(True))
    return F.when(blank, None).when(F.size(named) > 0, F.element_at(named, -1)).when(a & ~b, "A").when(b & ~a, "B")


def decode_position(reply) -> Column:
    """ONE, TWO or NEITHER; NEITHER wins, both positions are null."""
    t = F.upper(X.strip_thinking(reply))
    one, two = t.rlike(r"\bONE\b"), t.rlike(r"\bTWO\b")
    return F.when(t.rlike(r"\bNEITHER\b"), "NEITHER").when(one & ~two, "ONE").when(two & ~one, "TWO")


# --- fixed values: fate words, grades ---
FATES = ("RESOLVED", "ACKNOWLEDGED", "DROPPED")
GRADES = {"NONE": 0, "WEAK": 1, "CLOSE": 2, "VERBATIM": 3}
# --- end of fixed values ---


def decode_fate(reply, words: Sequence[str] = FATES) -> Column:
    """The one fate word a reply holds; none or several are null."""
    t = F.upper(X.strip_thinking(reply, unopened=False))
    hits = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in words]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def decode_consult(reply, known: Sequence[str]) -> Column:
    """Domain of the last CONSULT line, OTHER when unknown, null without one."""
    hits = F.regexp_extract_all(X.strip_thinking(reply), F.lit(r"CONSULT:\s*([A-Za-z]+)"), F.lit(1))
    named = F.lower(F.try_element_at(hits, F.lit(-1)))
    return F.when(F.size(hits) > 0, F.when(named.isin(*known), named).otherwise("OTHER"))


def decode_grade(reply) -> Column:
    """struct(grade, ref): grade word opening one of the first three lines (-1 if none), first number of a REF line."""
    lines = F.filter(F.transform(F.split(F.coalesce(X.as_col(reply), F.lit("")), "\n", -1), X.strip), lambda x: x != "")
    heads = F.transform(F.slice(lines, 1, 3), lambda ln: F.regexp_extract(F.upper(ln), r"^[*# ]*([^\s:.*#]+)", 1))
    table = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    graded = F.filter(F.transform(heads, lambda h: F.try_element_at(table, h)), lambda g: g.isNotNull())
    refs = F.filter(F.transform(F.filter(lines, lambda ln: F.contains(F.upper(ln), F.lit("REF"))),
                                lambda ln: F.regexp_extract(ln, r"(\d+)", 1)), lambda d: d != "")
    return F.struct(F.coalesce(F.get(graded, F.lit(0)), F.lit(-1)).alias("grade"),
                    F.coalesce(F.get(refs, F.lit(0)).cast("int"), F.lit(0)).alias("ref"))


def decode_verdict(reply, text_a, text_b, min_len: int = 15) -> Column:
    """A, B or TIE; null when malformed or when a quoted evidence is not in its text."""
    v = _object(reply)
    verdict = F.try_variant_get(v, "$.verdict", "string")
    def grounded(path, text):
        quotes = F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))
        body = X.norm(text, "word")
        return F.forall(quotes, lambda q: (F.length(X.strip(q)) < min_len) | F.contains(body, X.norm(q, "word")))
    ok = verdict.isin("A", "B", "TIE") & grounded("$.evidence_a", text_a) & grounded("$.evidence_b", text_b)
    return F.when(ok, verdict)


def parse_rates(decoded: DataFrame, judge: str, value: str) -> DataFrame:
    """Replies, usable replies and parse rate per judge: always beside any result."""
    return decoded.groupBy(judge).agg(F.count("*").alias("replies"), F.count(value).alias("parsed"),
                                      S.ratio(F.count(value), F.count("*")).alias("parse_rate"))


# ---------------------------------------------------------------- agreement

def paired(labels: DataFrame, unit: Sequence[str], a: str, b: str, value: str = "value") -> DataFrame:
    """Both judges' values side by side, by pivoting instead of a self-join."""
    return labels.groupBy(*unit).agg(
        F.max(F.when(F.col("judge") == a, F.col(value))).alias("a"), F.max(F.when(F.col("judge") == b, F.col(value))).alias("b"))


def both_agree(labels: DataFrame, unit: Sequence[str], a: str, b: str) -> DataFrame:
    """Label where both judges replied and agree; null where they differ or one is unusable."""
    return paired(labels, unit, a, b).withColumn("label", F.when(F.col("a") == F.col("b"), F.col("a")))


def agreement(labels: DataFrame, unit: Sequence[str], a: str, b: str, by: Sequence[str] = ("family",), bar: float = 0.70) -> DataFrame:
    """Agreement per family decision, unusable counts, agreement per class, and the gate."""
    p = paired(labels, unit, a, b)
    usable = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = usable & (F.col("a") == F.col("b"))
    g = p.groupBy(*by).agg(
        F.count("*").alias("decisions"), F.count_if(usable).alias("usable"), F.count_if(same).alias("agree"),
        F.count_if(same & F.col("a")).alias("both_yes"), F.count_if(same & ~F.col("a")).alias("both_no"))
    rate = S.ratio("agree", "usable")
    return g.select("*", rate.alias("rate"), F.when(rate >= bar, "pass").otherwise("fail").alias("gate"))


def judge_accuracy(labels: DataFrame, truth: DataFrame, unit: Sequence[str], bar: float = 0.80) -> DataFrame:
    """Accuracy per judge on known-truth anchors, parse failures, and the gate."""
    j = labels.join(truth, list(unit))
    g = j.groupBy("judge").agg(
        F.count("*").alias("asked"), F.count("value").alias("answered"),
        F.count_if(F.col("value") == F.col("truth")).alias("right"))
    acc = S.ratio("right", "answered")
    return g.select("*", acc.alias("accuracy"), S.ratio(F.col("asked") - F.col("answered"), "asked").alias("failure_rate"),
                    F.when(acc >= bar, "pass").otherwise("fail").alias("gate"))


def batch_gates(labels: DataFrame, truth: DataFrame, batches: DataFrame, a: str, b: str, scored: Sequence[str],
                consistent: float = 0.80, anchored: float = 0.80, failing: float = 0.20) -> DataFrame:
    """The gates of asking judges in batches, one row per batch size and gate: size, gate, subject, n, hits, rate, ok.

    parse        per judge: batches without a usable reply; below `failing`
    consistency  per scored family: where both judges replied, both saying yes equals the frozen label; at least `consistent`.
                 A scored family without such a unit fails
    anchor       per judge, all families: reply equals the known truth; at least `anchored`. A judge without one fails

    labels   size, unit, judge, family, value (null: no usable reply)
    truth    unit, family, truth, anchor (known truth; else a frozen label)
    batches  size, judge, parsed
    """
    rate = S.ratio("hits", "n")

    def gate(df, name, subject, ok):
        return df.select("size", F.lit(name).alias("gate"), F.col(subject).alias("subject"), "n", "hits", rate.alias("rate"),
                         F.coalesce(ok(rate), F.lit(False)).alias("ok"))
    judges, sizes = [a, b], batches.select("size").distinct()
    asked = batches.where(F.col("judge").isin(judges))
    parse = asked.groupBy("size", "judge").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce("parsed", F.lit(False))).alias("hits"))
    known = labels.where(F.col("judge").isin(judges)).join(truth, ["unit", "family"])
    both = known.where(~F.col("anchor") & F.col("family").isin(list(scored))).groupBy("size", "unit", "family").agg(
        F.max(F.when(F.col("judge") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("judge") == b, F.col("value"))).alias("b"),
        F.max("truth").alias("truth"))
    usable = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = both.groupBy("size", "family").agg(
        F.count_if(usable).alias("n"), F.count_if(usable & ((F.col("a") & F.col("b")) == F.col("truth"))).alias("hits"))
    right = known.where(F.col("anchor")).groupBy("size", "judge").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") == F.col("truth")).alias("hits"))

    def full(df, subject, names):
        wanted = sizes.select("size", F.explode(F.array(*[F.lit(x) for x in names])).alias(subject))
        return join_groups(wanted, df, ["size", subject], "left").fillna(0, ["n", "hits"])
    return gate(parse, "parse", "judge", lambda r: r < failing).unionByName(
        gate(full(same, "family", scored), "consistency", "family", lambda r: r >= consistent)).unionByName(
        gate(full(right, "judge", judges), "anchor", "judge", lambda r: r >= anchored))


def batch_verdict(gates: DataFrame) -> DataFrame:
    """Per batch size whether all gates hold, and the one to ship: the largest that passes, none if none does."""
    per = gates.groupBy("size").agg(F.count("*").alias("gates"), F.count_if(~F.col("ok")).alias("failed"))
    best = per.agg(F.max(F.when(F.col("failed") == 0, F.col("size"))).alias("_best"))
    return per.join(F.broadcast(best)).select("size", "gates", "failed", (F.col("failed") == 0).alias("passes"),
                                              F.coalesce(F.col("size") == F.col("_best"), F.lit(False)).alias("shipped"))


def attenuation(counts: DataFrame, slope: DataFrame, a: str = "a", b: str = "b", min_units: int = 8) -> DataFrame:
    """Inter-judge correlation, Spearman-Brown reliability and the disattenuated slope (the largest, if several rows come)."""
    g = counts.agg(F.count("*").alias("units"), F.corr(a, b).alias("r"))
    ok = F.col("units") >= min_units
    rel = F.when(ok & (F.col("r") > 0), 2 * F.col("r") / (1 + F.col("r")))
    return g.join(F.broadcast(slope.agg(F.max("slope").alias("slope")))).select(
        "units", F.when(ok, F.col("r")).alias("r"), rel.alias("reliability"), "slope", (F.col("slope") / rel).alias("disattenuated"),
        F.when(ok, "evaluable").otherwise("not evaluable").alias("status"))


def sign_test(wins, losses) -> Column:
    """Two-sided exact sign test; 1 when there is nothing to test.

    The first term of the fair binomial's upper tail comes in closed form; the terms behind it fall so fast that some
    ten square roots of the count hold all that a double can show.
    """
    w, l = S.c(wins).cast("double"), S.c(losses).cast("double")
    n, k = w + l, F.greatest(w, l)

    def rest(x):
        """ln x! beyond x ln x - x + ln(2 pi x) / 2."""
        exact = F.log(F.factorial(x.cast("int"))) - x * F.log(x) + x - F.log(F.lit(6.283185307179586) * x) / 2
        return F.when(x < 16, exact).otherwise(1 / (12 * x) - 1 / (360 * x * x * x))

    def tail(e):
        n, k = e["n"], e["k"]
        m = n - k
        d = (2 * k - n) / n
        log_first = -k * F.log1p(d) - m * F.log1p(-d) + F.log(n / (F.lit(6.283185307179586) * k * m)) / 2 + rest(n) - rest(k) - rest(m)
        first = F.exp(F.when(m > 0, log_first).otherwise(-n * F.log(F.lit(2.0))))
        steps = F.least(m, F.ceil(10 * F.sqrt(n)) + 10).cast("bigint")
        walk = F.aggregate(F.sequence(F.lit(0).cast("bigint"), steps), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
                           lambda a, j: F.struct((a["t"] * (m - j) / (k + j + 1)).alias("t"), (a["s"] + a["t"]).alias("s")))
        return F.least(F.lit(1.0), 2 * first * walk["s"])

    return F.when(n == 0, F.lit(1.0)).otherwise(let(F.struct(n.alias("n"), k.alias("k")), tail))


# ---------------------------------------------------------------- preference

def pair_verdicts(judgments: DataFrame, unit: Sequence[str]) -> DataFrame:
    """S1, S2 or TIE per unit and judge from forward and reversed orderings; null when either is missing.

    Position A is the first arm forward and the second arm in reverse.
    """
    keys = list(unit)
    p = judgments.groupBy(*keys).agg(
        F.max(F.when(F.col("ordering") == "fwd", F.col("verdict"))).alias("f"),
        F.max(F.when(F.col("ordering") == "rev", F.col("verdict"))).alias("r"))
    wf = F.when(F.col("f") == "A", "S1").otherwise("S2")
    wr = F.when(F.col("r") == "B", "S1").otherwise("S2")
    ok = F.col("f").isNotNull() & F.col("r").isNotNull()
    return p.select(*keys, F.when(ok, F.when(wf == wr, wf).otherwise("TIE")).alias("verdict"))


def tallies(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wins, ties, invalids and the sign test per group."""
    v = F.col("verdict")
    g = verdicts.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(v == "S1").alias("s1"), F.count_if(v == "S2").alias("s2"),
        F.count_if(v == "TIE").alias("ties"), F.count_if(v.isNull()).alias("invalid"))
    return g.withColumn("p_value", sign_test("s1", "s2"))


def win_share(verdicts: DataFrame, by: Sequence[str], case: str, draws: int = 5000, seed: int = 0) -> DataFrame:
    """Share of the first arm among decisive pairs with a case bootstrap, and its side of one half."""
    from ledgerloom.operators.bootstrap import draws_of, intervals

    by = list(by)
    dec = verdicts.where(F.col("verdict").isin("S1", "S2"))
    units = dec.groupBy(*by, case).agg(F.count_if(F.col("verdict") == "S1").cast("double").alias("w"),
                                       F.count("*").cast("double").alias("m"))
    point = units.groupBy(*by).agg(F.sum("m").cast("bigint").alias("decisive"), S.ratio(F.sum("w"), F.sum("m")).alias("share"))
    ci = intervals(draws_of(units, by, ["w", "m"], key=[case], draws=draws, seed=seed), by, rule="truncate", draws=draws,
                   share=S.ratio("w", "m"))
    side = F.when(F.col("share_lo") > 0.5, "S1").when(F.col("share_hi") < 0.5, "S2").otherwise("spans")
    return join_groups(point, ci, by, "left").select(*by, "decisive", "share", "share_lo", "share_hi", side.alias("side"))


def replication(primary: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """Does a second judge land on the same side of one half?"""
    p = primary.select(*by, F.col("side").alias("primary_side"))
    s = second.select(*by, F.col("side").alias("second_side"))
    return join_groups(p, s, by).withColumn(
        "verdict", F.when(F.col("second_side") == "spans", "not replicated")
        .when(F.col("second_side") == F.col("primary_side"), "agrees").otherwise("contradicts"))


def preference_drivers(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """What winners have more of. verdicts carry len1, len2, feat1, feat2 of the two sides."""
    dec = verdicts.where(F.col("verdict").isin("S1", "S2"))
    s1 = F.col("verdict") == "S1"
    matched = F.abs(F.col("len1") - F.col("len2")) < 0.15 * F.greatest("len1", "len2")
    differs = F.col("feat1") != F.col("feat2")
    return dec.groupBy(*by).agg(
        F.count("*").alias("decisive"), S.ratio(F.count_if(s1 == (F.col("len1") > F.col("len2"))), F.count("*")).alias("winner_longer"),
        F.count_if(matched).alias("length_matched"), S.ratio(F.count_if(matched & s1), F.count_if(matched)).alias("matched_share"),
        F.count_if(differs).alias("feature_differs"),
        S.ratio(F.count_if(differs & (s1 == (F.col("feat1") > F.col("feat2")))), F.count_if(differs)).alias("winner_has_more"))


def judge_pilot(judgments: DataFrame, unit: Sequence[str], parse_gate: float, decisive_gate: float) -> DataFrame:
    """Parse and decisive rates per judge and the one selected; the direction of the verdicts is never exposed."""
    v = pair_verdicts(judgments, ["judge", *unit])
    g = v.groupBy("judge").agg(
        S.ratio(F.count("verdict"), F.count("*")).alias("parse_rate"),
        S.ratio(F.count_if(F.col("verdict").isin("S1", "S2")), F.count("*")).alias("decisive_rate"))
    g = g.withColumn("eligible", (F.col("parse_rate") >= parse_gate) & (F.col("decisive_rate") >= decisive_gate))
    best = g.where("eligible").agg(F.min(F.struct((-F.col("decisive_rate")).alias("d"), "judge"))["judge"].alias("_best"))
    return g.join(F.broadcast(best)).select("judge", "parse_rate", "decisive_rate", "eligible",
                                            F.coalesce(F.col("judge") == F.col("_best"), F.lit(False)).alias("selected"))


def directive_shift(adopted: DataFrame, arm: str, control: str, value: str, min_n: int = 6, draws: int = 5000, seed: int = 0) -> DataFrame:
    """Share of the first value among decisive rows per arm, and its shift from the control arm.

    adopted  arm and value (1 first, 0 second; null rows are not decisive)
    """
    from ledgerloom.operators.bootstrap import draws_of, intervals

    dec = adopted.where(F.col(value).isNotNull()).select(arm, F.col(value).cast("int").alias("v"))
    point = dec.groupBy(arm).agg(F.count("*").alias("n"), F.avg("v").alias("share"))
    drawn = draws_of(dec, [arm], ["v"], draws=draws, seed=seed).select(arm, "draw", S.ratio("v", "n").alias("m"))
    ref = drawn.where(F.col(arm) == control).select("draw", F.col("m").alias("m0"))
    ci = intervals(drawn.where(~F.col(arm).eqNullSafe(F.lit(control))).join(ref, "draw"), [arm], rule="fixed", draws=draws, shift=F.col("m") - F.col("m0"))
    base = point.where(F.col(arm) == control).select(F.col("n").alias("n0"), F.col("share").alias("share0"))
    ok = (F.col("n") >= min_n) & (F.col("n0") >= min_n)
    j = join_groups(point, ci, [arm]).join(F.broadcast(base))
    return j.select(arm, "n", "share", "share0", F.when(ok, F.col("shift_lo")).alias("shift_lo"), F.when(ok, F.col("shift_hi")).alias("shift_hi"),
                    F.when(~ok | F.col("shift_lo").isNull(), "not evaluable").when(F.col("shift_hi") < 0, "down")
                    .when(F.col("shift_lo") > 0, "up").otherwise("none").alias("moved"))


def fate(labels: DataFrame, unit: Sequence[str], a: str, b: str, pos: str, cap: int = 4) -> DataFrame:
    """Agreed fates by (capped) list position, with the overall shares and headroom."""
    p = paired(labels, [*unit, pos], a, b, "fate")
    ok = p.where((F.col("a") == F.col("b")))
    g = ok.groupBy(F.least(F.col(pos), F.lit(cap)).alias("position"), F.col("a").alias("fate")).agg(F.count("*").alias("n"))
    tot = g.groupBy("position").agg(F.sum("n").alias("agreed"))
    return g.join(tot, "position").withColumn("share", S.ratio("n", "agreed"))


def fate_summary(labels: DataFrame, unit: Sequence[str], a: str, b: str) -> DataFrame:
    """Judged, quarantined, disagreeing and agreed items; headroom = agreed items that are not RESOLVED."""
    p = paired(labels, unit, a, b, "fate")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = both & (F.col("a") == F.col("b"))
    g = p.agg(F.count("*").alias("judged"), F.count_if(~both).alias("quarantined"), F.count_if(both & ~same).alias("disagree"),
              F.count_if(same).alias("agreed"), F.count_if(same & (F.col("a") != "RESOLVED")).alias("open"))
    lo, hi = S.wilson("open", "agreed")
    return g.select("*", S.ratio("open", "agreed").alias("headroom"), lo.alias("headroom_lo"), hi.alias("headroom_hi"),
                    F.when(F.col("agreed") > 0, "evaluable").otherwise("not evaluable").alias("status"))


def fate_marginals(labels: DataFrame, unit: Sequence[str], a: str, b: str, agreed: str = "agreed") -> DataFrame:
    """Fates per judge and among the agreed labels, each with its share of the usable ones and a Wilson interval."""
    p = paired(labels, unit, a, b, "fate")
    each = F.explode(F.array(
        F.struct(F.lit(a).alias("rater"), F.col("a").alias("fate")), F.struct(F.lit(b).alias("rater"), F.col("b").alias("fate")),
        F.struct(F.lit(agreed).alias("rater"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("fate"))))
    g = p.groupBy("a", "b").agg(F.count("*").alias("n")).select(each.alias("e"), "n").select("e.*", "n")
    g = g.where(F.col("fate").isNotNull()).groupBy("rater", "fate").agg(F.sum("n").alias("n"))
    g = g.join(g.groupBy("rater").agg(F.sum("n").alias("usable")), "rater")
    lo, hi = S.wilson("n", "usable")
    return g.select("rater", "fate", "n", "usable", S.ratio("n", "usable").alias("share"), lo.alias("share_lo"), hi.alias("share_hi"))


def flag_gap(runs: DataFrame, item: str, draws: int = 5000, seed: int = 0) -> DataFrame:
    """Does a deferral flag discriminate? Flag rate out of domain minus in domain, and routing among flags.

    runs  item, cond (out, in), flag (null = none), home
    """
    from ledgerloom.operators.estimators import cluster_difference

    f = runs.withColumn("_f", F.col("flag").isNotNull().cast("int"))
    gap = cluster_difference(f, item, "cond", "out", "in", "_f", draws=draws, seed=seed)
    route = f.where((F.col("cond") == "out") & (F.col("_f") == 1)).agg(
        F.count("*").alias("flags"), F.count_if(F.col("flag") == F.col("home")).alias("routed"))
    lo, hi = S.wilson("routed", "flags")
    verdict = (F.when(F.col("diff_lo").isNull(), "not evaluable").when(F.col("diff_lo") > 0, "discriminates")
               .when((F.col("rate_a") >= 0.8) & (F.col("rate_b") >= 0.8), "ceiling")
               .when((F.col("rate_a") <= 0.2) & (F.col("rate_b") <= 0.2), "floor").otherwise("no gap"))
    return gap.join(F.broadcast(route)).select(
        F.col("rate_a").alias("out_rate"), F.col("rate_b").alias("in_rate"), "diff_lo", "diff_hi", verdict.alias("verdict"), "flags", "routed",
        S.ratio("routed", "flags").alias("routing"), lo.alias("routing_lo"), hi.alias("routing_hi"))


def validate_matcher(grades: DataFrame, unit: Sequence[str], a: str, b: str, auc_bar: float = 0.80, agree_bar: float = 0.70) -> DataFrame:
    """Matcher validation: per pool mean grade, attrition and agreement on grade >= 2, beside the pooled gates.

    grades  unit, pool, judge, grade (negative = unparseable)
    """
    g = grades.withColumn("_g", F.when(F.col("grade") >= 0, F.col("grade")))
    p = paired(g, [*unit, "pool"], a, b, "_g")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = ok & ((F.col("a") >= 2) == (F.col("b") >= 2))
    per = p.groupBy("pool").agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("quarantined"), F.avg(F.when(ok, (F.col("a") + F.col("b")) / 2.0)).alias("mean_grade"),
        S.ratio(F.count_if(same), F.count_if(ok)).alias("agreement"))
    scored = p.where(ok & F.col("pool").isin("POS", "NEG")).select(
        F.lit(1).alias("one"), (F.col("pool") == "POS").alias("y"), ((F.col("a") + F.col("b")) / 2.0).alias("g"))
    overall = p.agg(S.ratio(F.count_if(same), F.count_if(ok)).alias("pooled_agreement"))
    auc = R.auc(scored, ["one"], "y", "g").select("auc")
    return per.join(F.broadcast(overall)).join(F.broadcast(auc)).withColumn(
        "gate", F.when((F.col("auc") >= auc_bar) & (F.col("pooled_agreement") >= agree_bar), "pass").otherwise("fail"))
