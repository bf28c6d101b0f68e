"""Estimators over audited runs.

Each reduces the runs to counted cells first and works on the cells, so the cost of fits, intervals and
guards does not grow with the runs. Every result carries a status: an estimate the data cannot support
comes back null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.detectors import MARK, detector, plain
from ledgerloom.functions import stats as S
from ledgerloom.functions.groups import join_groups
from ledgerloom.operators.bootstrap import draws_of, draws_of_cells, intervals, multinomial_draws

POWERS = {"sx": "x", "sy": "y", "sxx": "x*x", "sxy": "x*y", "syy": "y*y", "sx3": "x*x*x", "sx4": "x*x*x*x",
          "sxxy": "x*x*y"}


def precount(audited: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs counted by everything the estimators read (column _runs).

    Estimators built on one precounted frame share its exchange, so texts are scanned and matched once.
    """
    keys = list(dict.fromkeys([*by, "prompt_id", "condition", "writer_id", "floor_guard", "supply", "emitted", "n_invented"]))
    return audited.groupBy(*keys).agg(F.count("*").alias("_runs"))


def _runs(df: DataFrame) -> Column:
    return F.col("_runs") if "_runs" in df.columns else F.lit(1).cast("bigint")


def supply_cells(audited: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs above the floor counted by (by, supply, emitted)."""
    counted = F.sum(F.when(~F.col("floor_guard"), _runs(audited))).alias("_m")
    return audited.groupBy(*by, F.col("supply").alias("x"), F.col("emitted").alias("y")).agg(counted).where("_m > 0")


def sums(cells: DataFrame, by: Sequence[str], weight: str = "_m") -> DataFrame:
    """n and power sums per group."""
    return cells.groupBy(*by).agg(
        F.sum(weight).alias("n"), F.count_distinct("x").alias("levels"),
        *[F.sum(F.col(weight) * F.expr(e)).alias(k) for k, e in POWERS.items()])


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares per group from power sums, exact for whole numbers; null slope when x is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(both, F.col(x)), F.when(both, F.col(y))
    power = df.groupBy(*by).agg(F.count(u).alias("n"), F.sum(u).alias("_x"), F.sum(v).alias("_y"), F.sum(u * u).alias("_xx"),
                                F.sum(u * v).alias("_xy"), F.sum(v * v).alias("_yy"))
    t = S.ols_terms("n", "_x", "_y", "_xx", "_xy", "_yy")
    return power.select(*by, "n", t["slope"].alias("slope"), t["intercept"].alias("intercept"), t["r2"].alias("r2"))


def quadratic(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Curvature of y = c + b x + a x^2 from one pass of power sums."""
    cells = df.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("_m"))
    return sums(cells, by).select(
        *by, "n", S.quadratic_term("n", "sx", "sxx", "sx3", "sx4", "sy", "sxy", "sxxy").alias("a"))


def ols_interval(cells: DataFrame, by: Sequence[str], draws: int = 2000, seed: int = 0,
                 rule: str = "floor_ceil") -> DataFrame:
    """Bootstrap intervals of slope, intercept and curvature from counted (x, y) cells."""
    stats = cells.select(*by, "_m", *[F.expr(e).cast("bigint").alias(k) for k, e in POWERS.items()])
    drawn = draws_of_cells(stats, by, list(POWERS), draws, seed)
    t = S.ols_terms("n", "sx", "sy", "sxx", "sxy")
    half = max(500, draws // 2)
    quad = F.when(F.col("draw") < half, S.quadratic_term("n", "sx", "sxx", "sx3", "sx4", "sy", "sxy", "sxxy"))
    return intervals(drawn, by, rule=rule, draws=draws, needs={"quad": half * 0.5},
                     w=t["slope"], c=t["intercept"], quad=quad)


def ols_interval_classical(audited: DataFrame, by: Sequence[str], key: Sequence[str], draws: int = 2000, seed: int = 0,
                           rule: str = "floor_ceil") -> DataFrame:
    """Intervals of slope and intercept over runs above the floor, resampled with replacement; key identifies a run."""
    runs = audited.where(~F.col("floor_guard")).select(
        *by, *[k for k in key if k not in by], F.col("supply").cast("bigint").alias("x"), F.col("emitted").cast("bigint").alias("y"))
    stats = {k: POWERS[k] for k in ("sx", "sy", "sxx", "sxy")}
    runs = runs.select(*by, *[k for k in key if k not in by], *[F.expr(e).alias(k) for k, e in stats.items()])
    t = S.ols_terms("n", "sx", "sy", "sxx", "sxy")
    return intervals(multinomial_draws(runs, by, list(stats), key, draws, seed), by, rule=rule, draws=draws, w=t["slope"], c=t["intercept"])


def shrinkage(audited: DataFrame, by: Sequence[str] = ("condition",), families: int = 0, draws: int = 2000,
              seed: int = 0, min_levels: int = 3, min_runs: int = 10, min_zero: int = 5,
              max_width: float = 0.35) -> DataFrame:
    """The shrinkage law emitted = w * supply + c per group, with all its guards.

    families  size of the lexicon, for the ceiling note (0: no note)
    """
    by = list(by)
    cells = supply_cells(audited, by)
    strata = cells.groupBy(*by, "x").agg(
        F.sum("_m").alias("_m"), F.sum(F.col("_m") * F.col("y")).alias("_sy"))
    strata = strata.withColumn("my", F.col("_sy") / F.col("_m"))
    per = strata.groupBy(*by).agg(
        F.count("*").alias("levels"), F.regr_r2("my", F.col("x").cast("double")).alias("r2_strata"),
        F.regr_syy("my", F.col("x").cast("double")).alias("_syy"),
        F.coalesce(F.max(F.when(F.col("x") == 0, F.col("_m"))), F.lit(0)).alias("zero_n"),
        F.max("x").alias("max_supply"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_m") < 10, F.col("x")))), ",").alias("thin"))
    fit = sums(cells, by).drop("levels")
    t = S.ols_terms("n", "sx", "sy", "sxx", "sxy", "syy")
    out = join_groups(join_groups(fit, per, by), ols_interval(cells, by, draws, seed), by, "left")
    identifiable = (F.col("levels") >= min_levels) & (F.col("n") >= min_runs)

    def only(e: Column) -> Column:
        return F.when(identifiable, e)

    out = out.select(
        *by, F.col("n").alias("n_runs"), "levels", only(t["slope"]).alias("w"), only(F.col("w_lo")).alias("w_lo"),
        only(F.col("w_hi")).alias("w_hi"), only(t["intercept"]).alias("c"), only(F.col("c_lo")).alias("c_lo"),
        only(F.col("c_hi")).alias("c_hi"), only(t["r2"]).alias("r2_runs"),
        only(F.when(F.col("_syy") > 1e-12, F.col("r2_strata"))).alias("r2_strata"),
        only(S.quadratic_term("n", "sx", "sxx", "sx3", "sx4", "sy", "sxy", "sxxy")).alias("quad"),
        only(F.col("quad_lo")).alias("quad_lo"), only(F.col("quad_hi")).alias("quad_hi"),
        "zero_n", "max_supply", "thin", identifiable.alias("identifiable"))
    width = F.coalesce(F.col("w_hi") - F.col("w_lo"), F.lit(float("inf")))
    out = out.withColumn("weak", F.col("identifiable") & (width > max_width))
    out = out.withColumn("extrapolated", F.col("identifiable") & (F.col("zero_n") < min_zero))
    out = out.withColumn("curved", F.coalesce((F.col("quad_lo") > 0) | (F.col("quad_hi") < 0), F.lit(False)))
    out = out.withColumn("ceiling", F.col("curved") & (F.col("quad") < 0) & F.lit(families > 0)
                         & (F.col("max_supply") >= families - 1))
    return out.withColumn("verdict", verdict())


def verdict() -> Column:
    return (
        F.when(~F.col("identifiable"), "unidentifiable")
        .when(F.col("weak"), "weakly identified")
        .when(F.col("extrapolated"), "c extrapolated")
        .when((F.col("w") >= 0.85) & (F.col("c") <= 0.15), "faithful transduction")
        .when(F.col("w") <= 0.15, "pure register")
        .otherwise("shrinkage"))


def strata(audited: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """Mean emitted per supply level."""
    return audited.where(~F.col("floor_guard")).groupBy(*by, "supply").agg(
        F.count("*").alias("n"), F.avg("emitted").alias("mean_emitted"))


#: Below this a fitted value counts as zero.
TINY = 1e-9


def predict(w, c, s) -> Column:
    return S.c(w) * s + S.c(c)


def prior_trust(w) -> Column:
    """(1 - w) / w, null when w is not positive (beyond rounding)."""
    return F.when(S.c(w) > TINY, (1 - S.c(w)) / S.c(w))


def compression(w, c, lo: float, hi: float) -> Column:
    """How far the step between two supplies is compressed; null where a ratio is undefined."""
    down = F.when(predict(w, c, lo) > TINY, predict(w, c, hi) / predict(w, c, lo))
    return down / (hi / lo)


def corner_verdict(cards: DataFrame, strata_table: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """Both corner systems must be excluded by the intervals, strata monotone within 0.05, no guard fired."""
    by = list(by)
    step = F.lag("mean_emitted").over(Window.partitionBy(*by).orderBy("supply"))
    mono = strata_table.withColumn("_up", F.coalesce(F.col("mean_emitted") >= step - 0.05, F.lit(True))).groupBy(
        *by).agg(F.every("_up").alias("monotone"))
    j = join_groups(cards, mono, by, "left")
    register = F.col("w_hi") <= 0.15
    faithful = (F.col("w_lo") >= 0.85) & (F.col("c_hi") <= 0.15)
    ex_register = F.col("w_lo") > 0.15
    ex_faithful = ~faithful & ((F.col("w_hi") < 0.85) | (F.col("c_lo") > 0.15))
    return j.select(
        *by, "w_lo", "w_hi", "c_lo", "c_hi", "monotone",
        F.when(~F.col("identifiable") | F.col("w_lo").isNull(), "unidentifiable")
        .when(F.col("weak") | F.col("extrapolated") | ~F.col("monotone") | register | faithful, "falsified")
        .when(ex_register & ex_faithful & (F.col("c_lo") > 0), "supported").otherwise("partial").alias("status"))


# ---------------------------------------------------------------- clean rate and selection

def clean_cells(audited: DataFrame, by: Sequence[str]) -> DataFrame:
    """Redraw cells (by, prompt, condition, writer, supply): runs, clean runs, inventions."""
    cell = list(dict.fromkeys([*by, "prompt_id", "condition", "writer_id", "supply"]))
    m = _runs(audited)
    # the floor is applied inside the aggregate: as a filter it would repeat the text work below the exchange
    m = F.when(~F.col("floor_guard"), m)
    return audited.groupBy(*cell).agg(
        F.sum(m).alias("n"), F.coalesce(F.sum(F.when(F.col("n_invented") == 0, m)), F.lit(0)).alias("k"),
        F.sum(F.col("n_invented") * m).alias("inv")).where("n > 0")


def worst_stratum(cells: DataFrame, by: Sequence[str], min_n: int = 5) -> DataFrame:
    """Lowest clean rate over strata with at least five runs, else over all; lower supply on ties."""
    by = list(by)
    st = cells.groupBy(*by, "supply").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("inv").alias("inv"))
    st = st.withColumn("p", F.col("k") / F.col("n"))
    pick = F.struct("p", "supply", "n", "k")
    g = st.groupBy(*by).agg(
        F.sum("n").alias("n_runs"), (F.sum("k") / F.sum("n")).alias("p0"), (F.sum("inv") / F.sum("n")).alias("lam"),
        F.min(F.when(F.col("n") >= min_n, pick)).alias("_a"), F.min(pick).alias("_b"))
    g = g.withColumn("_w", F.coalesce("_a", "_b"))
    lo, hi = S.wilson("_w.k", "_w.n")
    return g.select(*by, "n_runs", "p0", "lam", F.exp(-F.col("lam")).alias("poisson_p0"),
                    F.col("_w.supply").alias("worst_supply"), F.col("_w.p").alias("p_worst"), lo.alias("p_worst_lo"),
                    hi.alias("p_worst_hi"), F.col("_a").isNull().alias("thin"))


def clean_rate(audited: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    return worst_stratum(clean_cells(audited, by), by)


def best_of_n(audited: DataFrame, by: Sequence[str] = ("condition",), max_n: int = 6) -> DataFrame:
    """Clean probability of the best of n, by independence and measured without replacement in cells.

    The measured curve is exact: 1 - C(N-K, n) / C(N, n) averaged over cells with N >= n. It is taken at
    the worst stratum, or over all strata where no cell there has two runs.
    """
    by = list(by)
    cells = clean_cells(audited, by)
    worst = worst_stratum(cells, by).select(*by, "worst_supply", "p_worst")
    shapes = cells.where("n >= 2").groupBy(*by, "supply", "n", "k").agg(F.count("*").alias("cells"))
    s = join_groups(shapes, worst, by).withColumn("_at", F.col("supply") == F.col("worst_supply"))
    curve = []
    for n in range(1, max_n + 1):
        miss = F.lit(1.0)
        for i in range(n):
            miss = miss * F.greatest(F.col("n") - F.col("k") - i, F.lit(0)) / (F.col("n") - i)
        curve.append(F.struct(F.lit(n).alias("draws"), F.when(F.col("n") >= n, 1 - miss).alias("hit")))
    pts = s.select(*by, "_at", "cells", F.explode(F.array(*curve)).alias("e")).where("e.hit is not null")
    agg = pts.groupBy(*by, F.col("e.draws").alias("draws")).agg(
        F.sum(F.when(F.col("_at"), F.col("e.hit") * F.col("cells"))).alias("_h1"),
        F.sum(F.when(F.col("_at"), F.col("cells"))).alias("_c1"),
        F.sum(F.col("e.hit") * F.col("cells")).alias("_h0"), F.sum("cells").alias("_c0"))
    at_worst = agg.where("draws = 1").select(*by, F.col("_c1").isNotNull().alias("_own"))
    base = worst.select(*by, "p_worst", F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("draws"))
    j = join_groups(join_groups(base, at_worst, by, "left"), agg, [*by, "draws"], "left")
    own = F.coalesce("_own", F.lit(False))
    return j.select(
        *by, "draws", (1 - F.pow(1 - F.col("p_worst"), F.col("draws"))).alias("independent"),
        F.when(own, F.col("_h1") / F.col("_c1")).otherwise(F.col("_h0") / F.col("_c0")).alias("empirical"),
        F.coalesce(F.when(own, F.col("_c1")).otherwise(F.col("_c0")), F.lit(0)).alias("cells"), (~own).alias("pooled"))


def draws_needed(audited: DataFrame, by: Sequence[str] = ("condition",), target: float = 0.95, max_n: int = 6,
                 limit: int = 32, share: float = 0.5) -> DataFrame:
    """Smallest n reaching the target, preferring the measured curve while half the cells contribute."""
    by = list(by)
    curve = best_of_n(audited, by, max_n)
    one = curve.where("draws = 1").select(*by, (F.col("independent")).alias("_p"), F.col("cells").alias("_base"))
    grid = one.select(*by, "_p", "_base", F.explode(F.sequence(F.lit(1), F.lit(limit))).alias("draws"))
    j = join_groups(grid, curve.select(*by, "draws", "empirical", "cells"), [*by, "draws"], "left")
    seen = (F.col("_base") > 0) & F.coalesce(F.col("cells") >= F.col("_base") * share, F.lit(False)) & F.col(
        "empirical").isNotNull()
    hit = F.when(seen, F.col("empirical") >= target).otherwise(
        1 - F.pow(1 - F.col("_p"), F.col("draws")) >= target)
    basis = F.when(seen, F.lit("empirical")).otherwise(F.lit("independence"))
    g = j.withColumn("_hit", hit).withColumn("_basis", basis).groupBy(*by).agg(
        F.min(F.when(F.col("_hit"), F.struct("draws", "_basis"))).alias("r"))
    return g.select(*by, F.coalesce(F.col("r.draws"), F.lit(-1)).alias("n_needed"),
                    F.coalesce(F.col("r._basis"), F.lit("unreachable")).alias("basis"))


# ---------------------------------------------------------------- arms

def mean_difference(audited: DataFrame, baseline: str, arm: str = "condition", value: str = "n_invented",
                    draws: int = 5000, seed: int = 0) -> DataFrame:
    """Every arm against the baseline: difference of means with interval and verdict."""
    use = audited.where(~F.col("floor_guard"))
    lam = use.groupBy(arm).agg(F.count("*").alias("n"), F.avg(value).alias("lam"),
                               F.count_if(F.col(value) > 0).alias("runs_with_invention"))
    drawn = draws_of(use.select(arm, value), [arm], [value], draws=draws, seed=seed).select(
        arm, "draw", S.ratio(value, "n").alias("_mean"))
    ref = drawn.where(F.col(arm) == baseline).select("draw", F.col("_mean").alias("_ref"))
    ci = intervals(drawn.where(~F.col(arm).eqNullSafe(F.lit(baseline))).join(ref, "draw"), [arm], rule="truncate", draws=draws,
                   diff=F.col("_mean") - F.col("_ref"))
    rows = lam.where(F.col(arm) == baseline).select(F.col("lam").alias("lam_baseline"), F.col("n").alias("n_baseline"))
    return join_groups(lam, ci, [arm]).join(F.broadcast(rows)).select(
        arm, "n", "n_baseline", "lam", "lam_baseline", "diff_lo", "diff_hi", "runs_with_invention",
        F.when(F.col("diff_lo").isNull(), "not evaluable").when(F.col("diff_hi") < 0, "lower than baseline")
        .when(F.col("diff_lo") > 0, "higher than baseline").otherwise("not distinguishable").alias("verdict"))


def two_instrument(primary: DataFrame, secondary: DataFrame, arm: str = "condition") -> DataFrame:
    """Combine two mean_difference tables into the two-instrument verdict."""
    p = primary.select(arm, F.col("diff_lo").alias("p_lo"), F.col("diff_hi").alias("p_hi"))
    s = secondary.select(arm, F.col("diff_lo").alias("s_lo"), F.col("diff_hi").alias("s_hi"))
    pd, sd = (F.col("p_lo") > 0) | (F.col("p_hi") < 0), (F.col("s_lo") > 0) | (F.col("s_hi") < 0)
    return join_groups(p, s, [arm]).select(
        arm, "p_lo", "p_hi", "s_lo", "s_hi",
        F.when(pd & sd & ((F.col("p_hi") < 0) == (F.col("s_hi") < 0)), "confirmed").when(pd & sd, "contradictory")
        .when(pd, "instrument-relative").when(sd, "secondary only").otherwise("none").alias("verdict"))


def shared_prompts(runs: DataFrame, arm: str = "condition", prompt: str = "prompt_id") -> DataFrame:
    """Prompts every arm ran."""
    n_arms = runs.agg(F.count_distinct(arm).alias("_n"))
    per = runs.groupBy(prompt).agg(F.count_distinct(arm).alias("_k"))
    return per.join(F.broadcast(n_arms)).where("_k = _n").select(prompt)


def restrict_to_shared(runs: DataFrame, arm: str = "condition", prompt: str = "prompt_id") -> DataFrame:
    return runs.join(shared_prompts(runs, arm, prompt), prompt, "left_semi")


def check_comparable(runs: DataFrame, arm: str = "condition", prompt: str = "prompt_id",
                     writer: str = "writer_id") -> DataFrame:
    """Per arm: prompts, prompts not shared by all, writers, and whether it may be compared."""
    pairs = runs.groupBy(arm, prompt).agg(F.count("*").alias("_r"))
    shared = shared_prompts(pairs, arm, prompt).withColumn("_s", F.lit(1))
    p = join_groups(pairs, shared, [prompt], "left").groupBy(arm).agg(
        F.count("*").alias("prompts"), F.count_if(F.col("_s").isNull()).alias("own_prompts"))
    w = runs.groupBy(arm).agg(F.count_distinct(writer).alias("writers"))
    return join_groups(p, w, [arm]).select("*", ((F.col("own_prompts") == 0) & (F.col("writers") <= 1)).alias("comparable"))


# ---------------------------------------------------------------- pooled and clustered

def meta(fits: DataFrame, est: str = "w", lo: str = "w_lo", hi: str = "w_hi", n: str = "n_runs",
         min_n: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """DerSimonian-Laird pooling of interval estimates, with the prediction interval."""
    by = list(by)
    use = fits.where((F.col(n) >= min_n) & F.col("identifiable") & F.col(lo).isNotNull() & (F.col(hi) > F.col(lo)))
    use = use.select(*by, F.col(est).alias("e"), F.pow((F.col(hi) - F.col(lo)) / 3.92, 2).alias("v"))
    fe = use.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum(1 / F.col("v")).alias("sw"), F.sum(F.col("e") / F.col("v")).alias("swe"),
        F.sum(F.col("e") * F.col("e") / F.col("v")).alias("swee"), F.sum(1 / (F.col("v") * F.col("v"))).alias("sww"))
    q = F.col("swee") - F.col("swe") * F.col("swe") / F.col("sw")
    den = F.col("sw") - F.col("sww") / F.col("sw")
    tau2 = F.when(den > 1e-12, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / den)).otherwise(F.lit(0.0))
    fe = fe.select(*by, "k", tau2.alias("tau2"))
    j = join_groups(use, fe, by) if by else use.join(F.broadcast(fe))
    w = 1 / (F.col("v") + F.col("tau2"))
    re = j.groupBy(*by).agg(F.max("k").alias("k"), F.max("tau2").alias("tau2"), F.sum(w).alias("sw"),
                            F.sum(w * F.col("e")).alias("swe"))
    mu, se = F.col("swe") / F.col("sw"), F.sqrt(1 / F.col("sw"))
    half = 1.96 * F.sqrt(F.col("tau2") + se * se)
    return re.select(*by, "k", mu.alias("mu"), se.alias("se"), (mu - 1.96 * se).alias("mu_lo"),
                     (mu + 1.96 * se).alias("mu_hi"), F.sqrt("tau2").alias("tau"), (mu - half).alias("pi_lo"),
                     (mu + half).alias("pi_hi"))


def icc_groups(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Sufficient statistics of repeated groups: n, sum, sum of squares."""
    return df.groupBy(*group).agg(
        F.count("*").alias("g"), F.sum(value).cast("double").alias("sx"),
        F.sum(F.col(value) * F.col(value)).cast("double").alias("sxx")).where("g >= 2")


def _icc(k, n, sn2, sx, ssb_raw, sxx) -> Column:
    """One-way ICC with unequal groups from totals: groups, runs, sum n^2, sum x, sum (sum x)^2/n, sum x^2."""
    k, n, sn2, sx, ssb_raw, sxx = (S.c(v).cast("double") for v in (k, n, sn2, sx, ssb_raw, sxx))
    msb = F.when(k > 1, (ssb_raw - sx * sx / n) / (k - 1))
    msw = F.when(n > k, (sxx - ssb_raw) / (n - k)).otherwise(F.lit(0.0))
    n0 = (n - sn2 / n) / (k - 1)
    den = msb + (n0 - 1) * msw
    return F.when(den > 1e-12, (msb - msw) / den).when(den.isNotNull(), F.lit(0.0))


def icc(df: DataFrame, group: Sequence[str], value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Intra-class correlation of repeated groups with a group bootstrap."""
    g = icc_groups(df, group, value).select(
        "g", (F.col("g") * F.col("g")).alias("sn2"), "sx", (F.col("sx") * F.col("sx") / F.col("g")).alias("ssb"), "sxx")
    point = g.agg(F.count("*").alias("groups"), F.sum("g").alias("runs"), F.sum("sn2").alias("sn2"),
                  F.sum("sx").alias("sx"), F.sum("ssb").alias("ssb"), F.sum("sxx").alias("sxx"))
    # groups with equal (n, sum, sum of squares) are interchangeable units
    cells = g.select(F.lit(1).alias("one"), F.col("g").cast("bigint").alias("g"), F.col("sx").cast("bigint").alias("s"),
                     F.col("sxx").cast("bigint").alias("q")).groupBy("one", "g", "s", "q").agg(F.count("*").alias("_m"))
    drawn = draws_of_cells(
        cells.select("one", "_m", "g", "s", "q", (F.col("g") * F.col("g")).alias("gg"),
                     (F.col("s") * F.col("s") / F.col("g")).alias("b")), ["one"], ["g", "s", "q", "gg", "b"],
        draws, seed, ident=["one", "g", "s", "q"])
    ci = intervals(drawn, ["one"], rule="fixed", draws=draws, icc=_icc("n", "g", "gg", "s", "b", "q")).drop("one")
    return point.join(F.broadcast(ci)).select(
        "groups", "runs", _icc("groups", "runs", "sn2", "sx", "ssb", "sxx").alias("icc"), "icc_lo", "icc_hi")


def dispersion(df: DataFrame, cell: Sequence[str], value: str, min_n: int = 15) -> DataFrame:
    """Variance over mean per cell with at least 15 runs and a positive mean."""
    g = df.groupBy(*cell).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return g.where((F.col("n") >= min_n) & (F.col("mean") > 0)).withColumn("index", F.col("var") / F.col("mean"))


def decompose_slope(audited: DataFrame, lex, draws: int = 2000, seed: int = 0) -> DataFrame:
    """cov(supply, family present) / var(supply) per family; the shares sum to the slope."""
    from ledgerloom.functions import text as X
    from ledgerloom.lexicons import lexicon

    fams = list(lexicon(lex))
    cells = audited.where(~F.col("floor_guard")).groupBy(F.lit(1).alias("one"), F.col("supply").alias("x"),
                                                         F.col("present_mask").alias("m")).agg(F.count("*").alias("_m"))
    x = F.col("x").cast("bigint")
    cols = {"sx": x, "sxx": x * x}
    for i, _ in enumerate(fams):
        bit = X.mask_has("m", i).cast("bigint")
        cols[f"y{i}"], cols[f"xy{i}"] = bit, bit * x
    stats = cells.select("one", "_m", "m", x.alias("x"), *[e.alias(k) for k, e in cols.items()])
    tot = stats.groupBy("one").agg(F.sum("_m").alias("n"), *[F.sum(F.col("_m") * F.col(k)).alias(k) for k in cols])

    def share(i):
        n = F.col("n").cast("double")
        v = n * F.col("sxx") - F.col("sx") * F.col("sx")
        return F.when(v > 1e-9, (n * F.col(f"xy{i}") - F.col("sx") * F.col(f"y{i}")) / v)

    drawn = draws_of_cells(stats, ["one"], list(cols), draws, seed, ident=["one", "x", "m"])
    ci = intervals(drawn, ["one"], rule="fixed", draws=draws, **{f"s{i}": share(i) for i in range(len(fams))})
    j = tot.join(ci, "one")
    slope = sum((share(i) for i in range(1, len(fams))), share(0))
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), share(i).alias("share"), F.col(f"s{i}_lo").alias("share_lo"),
                 F.col(f"s{i}_hi").alias("share_hi")) for i, f in enumerate(fams)]))
    return j.select(rows.alias("e"), slope.alias("slope")).select("e.*", "slope")


def cluster_difference(df: DataFrame, cluster: str, arm: str, a: str, b: str, num: str, den: str | None = None,
                       by: Sequence[str] = (), draws: int = 2000, seed: int = 0, rule: str = "truncate",
                       min_clusters: int = 1) -> DataFrame:
    """Difference of two arms' rates with a bootstrap over clusters.

    Rows are first reduced to one (sum, count) pair of sums per cluster, so the resampled table holds
    clusters and never rows; a cluster missing an arm contributes zero there.
    """
    by = list(by) or ["_all"]
    if by == ["_all"]:
        df = df.withColumn("_all", F.lit(1))
    d = F.col(den) if den else F.lit(1)
    use = F.col(num).isNotNull()

    def tot(which, e):
        return F.coalesce(F.sum(F.when(use & (F.col(arm) == which), e)), F.lit(0)).cast("double")

    units = df.groupBy(*by, cluster).agg(
        tot(a, F.col(num)).alias("na"), tot(a, d).alias("da"), tot(b, F.col(num)).alias("nb"), tot(b, d).alias("db"))
    units = units.where("da > 0 or db > 0")
    point = units.groupBy(*by).agg(F.count("*").alias("clusters"), *[F.sum(x).alias(x) for x in ("na", "da", "nb", "db")])
    drawn = draws_of(units, by, ["na", "da", "nb", "db"], key=[cluster], draws=draws, seed=seed)
    diff = S.ratio("na", "da") - S.ratio("nb", "db")
    ci = intervals(drawn, by, rule=rule, draws=draws, diff=diff)
    out = join_groups(point, ci, by, "left")
    usable = (F.col("clusters") >= min_clusters) & (F.col("da") > 0) & (F.col("db") > 0)
    keep = [x for x in by if x != "_all"]
    return out.select(
        *keep, "clusters", S.ratio("na", "da").alias("rate_a"), S.ratio("nb", "db").alias("rate_b"),
        F.when(usable, diff).alias("diff"), F.when(usable, F.col("diff_lo")).alias("diff_lo"),
        F.when(usable, F.col("diff_hi")).alias("diff_hi"),
        F.when(~usable | F.col("diff_lo").isNull(), "not evaluable")
        .when((F.col("diff_lo") > 0) | (F.col("diff_hi") < 0), "distinguishable")
        .otherwise("not distinguishable").alias("status"))


def cluster_slope(df: DataFrame, cluster: str, x: str, y: str, by: Sequence[str] = ("condition",), draws: int = 2000,
                  seed: int = 0, rule: str = "floor_ceil") -> DataFrame:
    """Slope per group with a bootstrap over clusters, from per-cluster power sums."""
    by = list(by)
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    units = df.groupBy(*by, cluster).agg(
        F.count("*").cast("double").alias("m"), F.sum(xx).alias("sx"), F.sum(yy).alias("sy"), F.sum(xx * xx).alias("sxx"),
        F.sum(xx * yy).alias("sxy"))
    cols = ["m", "sx", "sy", "sxx", "sxy"]
    point = units.groupBy(*by).agg(F.count("*").alias("clusters"), *[F.sum(k).alias(k) for k in cols])
    drawn = draws_of(units, by, cols, key=[cluster], draws=draws, seed=seed)
    slope = S.ols_terms("m", "sx", "sy", "sxx", "sxy")["slope"]
    ci = intervals(drawn, by, rule=rule, draws=draws, slope=slope)
    return join_groups(point, ci, by, "left").select(*by, "clusters", F.col("m").cast("bigint").alias("n"), slope.alias("slope"),
                                             "slope_lo", "slope_hi")


def slope_difference(df: DataFrame, cluster: str, x: str, y: str, arm: str, a: str, b: str, draws: int = 2000,
                     seed: int = 0) -> DataFrame:
    """Slope of arm a minus slope of arm b over the clusters both arms have, clusters resampled jointly."""
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    cols = {}
    for tag, which in (("a", a), ("b", b)):
        on = F.col(arm) == which
        for k, e in {"m": F.lit(1.0), "sx": xx, "sy": yy, "sxx": xx * xx, "sxy": xx * yy}.items():
            cols[k + tag] = F.coalesce(F.sum(F.when(on, e)), F.lit(0.0))
    units = df.withColumn("_all", F.lit(1)).groupBy("_all", cluster).agg(*[e.alias(k) for k, e in cols.items()])
    units = units.where("ma > 0 and mb > 0")
    def diff():
        return (S.ols_terms("ma", "sxa", "sya", "sxxa", "sxya")["slope"]
                - S.ols_terms("mb", "sxb", "syb", "sxxb", "sxyb")["slope"])
    point = units.groupBy("_all").agg(F.count("*").alias("clusters"), *[F.sum(k).alias(k) for k in cols])
    drawn = draws_of(units, ["_all"], list(cols), key=[cluster], draws=draws, seed=seed)
    ci = intervals(drawn, ["_all"], draws=draws, diff=diff())
    return point.join(ci, "_all").select("clusters", diff().alias("diff"), "diff_lo", "diff_hi")


def paired_difference(scored: DataFrame, item: str, arm: str, order: str, a: str, b: str, value: str = "score",
                      min_items: int = 10, draws: int = 5000, seed: int = 0) -> DataFrame:
    """Mean of per-item differences over items both arms have (the last repeat of each counts)."""
    def last(which):
        return F.max_by(F.when(F.col(arm) == which, F.col(value)), F.when(F.col(arm) == which, F.col(order)))

    units = scored.groupBy(item).agg(last(a).alias("_a"), last(b).alias("_b")).where(
        F.col("_a").isNotNull() & F.col("_b").isNotNull())
    units = units.select(F.lit(1).alias("_all"), item, (F.col("_a") - F.col("_b")).cast("double").alias("d"))
    point = units.groupBy("_all").agg(F.count("*").alias("items"), F.avg("d").alias("diff"))
    ci = intervals(draws_of(units, ["_all"], ["d"], key=[item], draws=draws, seed=seed), ["_all"], rule="fixed",
                   draws=draws, diff=S.ratio("d", "n"))
    ok = F.col("items") >= min_items
    return point.join(ci, "_all").select(
        "items", F.when(ok, F.col("diff")).alias("diff"), F.when(ok, F.col("diff_lo")).alias("diff_lo"),
        F.when(ok, F.col("diff_hi")).alias("diff_hi"),
        F.when(ok, F.lit("evaluable")).otherwise(F.lit("not evaluable")).alias("status"))


def difference_in_differences(df: DataFrame, group: str, arm: str, a: str, b: str, channel: str, min_events: int = 5,
                              draws: int = 5000, seed: int = 0) -> DataFrame:
    """(arm - base on channel 1) - (arm - base on channel 0) per group; four binary samples resampled apart.

    df  group, arm, channel (0/1), event (0/1)
    """
    use = df.where(F.col(arm).isin(a, b)).select(
        F.col(group), (F.col(arm) == a).cast("int").alias("t"), F.col(channel).cast("int").alias("ch"),
        F.col("event").cast("int").alias("e"))
    cells = use.groupBy(group, "t", "ch", "e").agg(F.count("*").alias("_m"))
    drawn = draws_of_cells(cells, [group, "t", "ch"], ["e"], draws, seed)
    def mean(t, ch, num, den):
        on = (F.col("t") == t) & (F.col("ch") == ch)
        return S.ratio(F.sum(F.when(on, F.col(num))), F.sum(F.when(on, F.col(den))))
    def did(num, den):
        return (mean(1, 1, num, den) - mean(0, 1, num, den)) - (mean(1, 0, num, den) - mean(0, 0, num, den))
    per = drawn.groupBy(group, "draw").agg(did("e", "n").alias("v"))
    ci = intervals(per, [group], rule="truncate", draws=draws, did=F.col("v"))
    counted = cells.withColumn("_e", F.col("e") * F.col("_m"))
    point = counted.groupBy(group).agg(
        did("_e", "_m").alias("did"), F.coalesce(F.sum(F.when(F.col("ch") == 0, F.col("_e"))), F.lit(0)).alias("events"))
    ok = F.col("events") >= min_events
    return join_groups(point, ci, [group], "left").select(
        group, "events", F.when(ok, F.col("did")).alias("did"), F.when(ok, F.col("did_lo")).alias("did_lo"),
        F.when(ok, F.col("did_hi")).alias("did_hi"),
        F.when(~ok | F.col("did_lo").isNull(), "not evaluable").when(F.col("did_lo") > 0, "signature")
        .otherwise("not distinguishable").alias("status"))


def mean_interval(df: DataFrame, by: Sequence[str], key: Sequence[str], value: str, draws: int = 2000,
                  seed: int = 0) -> DataFrame:
    """Mean per group with a unit bootstrap."""
    by = list(by)
    drawn = draws_of(df.select(*by, *key, value), by, [value], key=key, draws=draws, seed=seed, spread=False, whole=True)
    mean, own = S.ratio(value, "n"), F.col("draw") < 0
    # one pass over the drawn sums: at most `draws` numbers a group
    packed = drawn.groupBy(*by).agg(F.max(F.when(own, F.col("n"))).cast("bigint").alias("n"), F.max(F.when(own, mean)).alias("mean"),
                                    F.sort_array(F.collect_list(F.when(~own, mean))).alias("_v"))
    lo, hi = S.interval("_v", "truncate")
    enough = F.size("_v") >= draws * 0.5
    return packed.select(*by, "n", "mean", F.when(enough, lo).alias("mean_lo"), F.when(enough, hi).alias("mean_hi"))


def moved(a_lo, a_hi, b_lo, b_hi) -> Column:
    """MOVED when two intervals are disjoint."""
    return F.when((S.c(b_lo) > S.c(a_hi)) | (S.c(a_lo) > S.c(b_hi)), "moved").otherwise("overlap")


def stage_composition(df: DataFrame, s: str, mid: str, y: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Do two stage fits compose to the direct fit? s -> mid -> y against s -> y."""
    pairs = {"first": (s, mid), "second": (mid, y), "direct": (s, y)}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("stage"), F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y"))
        for k, (a, b) in pairs.items()])).alias("e")).select("e.*")
    cells = long.groupBy("stage", "x", "y").agg(F.count("*").alias("_m"))
    t = S.ols_terms("n", "sx", "sy", "sxx", "sxy")
    fit = sums(cells, ["stage"]).select("stage", t["slope"].alias("w"), t["intercept"].alias("c")).join(
        ols_interval(cells, ["stage"], draws, seed), "stage", "left")

    def of(stage, col):
        return F.max(F.when(F.col("stage") == stage, F.col(col)))

    g = fit.agg(*[of(k, c).alias(f"{k}_{c}") for k in pairs for c in ("w", "c", "w_lo", "w_hi", "c_lo", "c_hi")])
    wp = F.col("first_w") * F.col("second_w")
    cp = F.col("second_w") * F.col("first_c") + F.col("second_c")
    w_in, c_in = wp.between(F.col("direct_w_lo"), F.col("direct_w_hi")), cp.between(
        F.col("direct_c_lo"), F.col("direct_c_hi"))
    return g.select("first_w", "first_c", "second_w", "second_c", "direct_w", "direct_c", wp.alias("predicted_w"),
                    cp.alias("predicted_c"), w_in.alias("w_inside"), c_in.alias("c_inside"),
                    F.when(w_in & c_in, "supported").otherwise("falsified").alias("status"))


def span_fraction(outputs: DataFrame, lex, by: Sequence[str] = ("condition",), min_chars: int = 200) -> DataFrame:
    """Share of characters and tokens in sentences where a family span starts: median, quartiles, dilution."""
    from ledgerloom.functions import text as X
    from ledgerloom.operators import ranks

    by, det = list(by), detector(lex)
    found = det.prepared(outputs.where(F.length("output") >= min_chars), ["output"])
    found = found.select(*dict.fromkeys([*by, "output", *[c for c in found.columns if c.startswith(MARK)]]))
    base = plain(X.held(found, "_sp", det.spans("output", F.col("output"))))
    base = X.held(base, "_so", X.sentence_offsets("output"))

    def tokens(t):
        return F.size(F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0)))

    hit = F.filter("_so", lambda s: F.exists("_sp", lambda p: (p["start"] >= s["start"]) & (p["start"] < s["end"])))
    cut = X.held(base, "_hit", hit)
    total = F.aggregate("_hit", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    hit_tokens = F.aggregate(
        "_hit", F.lit(0),
        lambda a, s: a + tokens(F.substr(F.col("output"), s["start"] + 1, s["end"] - s["start"])))
    vals = cut.select(*by, (total / F.length("output")).alias("f"),
                      (hit_tokens / F.greatest(F.lit(1), tokens(F.col("output")))).alias("ft"))
    q = ranks.many_quantiles(vals, by, {"f": {"f_median": "median", "f_p25": 0.25, "f_p75": 0.75}, "ft": {"f_median_tokens": "median"}})
    med = F.col("f_median")
    return q.select(
        *by, F.col("n").alias("n_runs"), "f_median", "f_p25", "f_p75", "f_median_tokens",
        F.when(med > 0, 1 / med).alias("dilution"), (F.col("f_zeros") > F.col("n") * 0.5).alias("mostly_zero"),
        F.when(med >= 0.5, "low dilution").otherwise("high dilution").alias("verdict"))


def classify_null(results: DataFrame, fired: str = "fired", n: str = "n", lo: str = "diff_lo", hi: str = "diff_hi",
                  effect: float = 0.1, min_events: int = 5) -> DataFrame:
    """What a null result is worth: degenerate, uninformative, weak or informative."""
    outcome = (
        F.when((F.col(lo) > 0) | (F.col(hi) < 0), "not a null")
        .when(F.col(lo).isNull() | (F.col(fired) == 0) | (F.col(fired) == F.col(n)), "degenerate")
        .when(F.col(fired) < min_events, "uninformative")
        .when((F.col(hi) >= effect) | (F.col(lo) <= -effect), "weak")
        .otherwise("informative"))
    return results.withColumn("null_class", outcome)


def decorrelation(items: DataFrame, topic: str = "prompt_id", supply: str = "supply") -> DataFrame:
    """Normalised mutual information between topic and supply; balanced below 0.15."""
    joint = items.groupBy(topic, supply).agg(F.count("*").alias("c"))
    pm = joint.groupBy(topic).agg(F.sum("c").alias("a"))
    sm = joint.groupBy(supply).agg(F.sum("c").alias("b"))
    n = joint.agg(F.sum("c").alias("n"), F.count_distinct(topic).alias("n_prompts"))
    mi = join_groups(join_groups(joint, pm, [topic]), sm, [supply]).join(F.broadcast(n)).agg(
        F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    h = sm.join(F.broadcast(n)).agg(
        (-F.sum(F.col("b") / F.col("n") * F.log(F.col("b") / F.col("n")))).alias("hs"), F.max("b").alias("big"),
        F.min("b").alias("small"), F.count("*").alias("levels"))
    nmi = F.when(F.col("hs") > 0, F.col("mi") / F.col("hs")).otherwise(F.lit(0.0))
    return n.join(F.broadcast(mi)).join(F.broadcast(h)).select(
        F.col("n").alias("n_items"), "n_prompts", "levels", nmi.alias("nmi"), (nmi < 0.15).alias("balanced"),
        (F.col("big") > 3 * F.greatest(F.lit(1), F.col("small"))).alias("imbalanced"), (F.col("n") < 1000).alias("small"))
