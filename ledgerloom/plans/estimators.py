"""Estimator queries over the audited document runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import estimators as E
from ledgerloom.operators import ranks as R
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded

LEX = "prose"
FAMS = list(lexicon(LEX))
BASE = f"WITH {K.DEALT}, {K.audited(LEX)}, use AS MATERIALIZED (SELECT run_id, condition, writer_id, prompt_id, " \
       "supply::BIGINT AS x, emitted::BIGINT AS y, n_inv::BIGINT AS inv, n_kept::BIGINT AS nk, chars, present " \
       "FROM aud WHERE NOT floored)"
SUMS = ("count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy, "
        "sum(x*x*x) AS sx3, sum(x*x*x*x) AS sx4, sum(x*x*y) AS sxxy")
POW = ["sx", "sy", "sxx", "sxy", "syy", "sx3", "sx4", "sxxy"]


def pows(by: str, src: str = "use") -> str:
    return (f"(SELECT {by}, x AS sx, y AS sy, x*x AS sxx, x*y AS sxy, y*y AS syy, x*x*x AS sx3, x*x*x*x AS sx4, "
            f"x*x*y AS sxxy FROM {src})")


@query("e1_ols", f"""{BASE}, s AS (SELECT condition, {SUMS} FROM use GROUP BY 1)
  SELECT condition, n, round({K.slope()}, 6) AS slope, round({K.intercept()}, 6) AS intercept, round({K.r2()}, 6) AS r2 FROM s""")
def e1_ols(t):
    return rounded(E.ols(t.audited().where(~F.col("floor_guard")).select(
        "condition", F.col("supply").cast("double").alias("x"), F.col("emitted").cast("double").alias("y")),
        "x", "y", ["condition"]))


@query("e2_quadratic", f"""{BASE}, s AS (SELECT condition, {SUMS} FROM use GROUP BY 1)
  SELECT condition, n, round({K.quad()}, 6) AS a FROM s""")
def e2_quadratic(t):
    return rounded(E.quadratic(t.audited().where(~F.col("floor_guard")), "supply", "emitted", ["condition"]))


def _fits(by: str = "condition", src: str = "use", name: str = "b") -> str:
    """CTEs b (draws) and b_ci (intervals of w, c, quad) per group."""
    wlo, whi = K.ci(K.slope())
    clo, chi = K.ci(K.intercept())
    quad = f"CASE WHEN draw < 1000 THEN {K.quad()} END"
    qlo, qhi = K.ci("qd", draws=1000)
    return f"""{K.boot(name, pows(by, src), [by], POW)},
  {name}_q AS (SELECT *, {quad} AS qd FROM {name}),
  {name}_ci AS MATERIALIZED (SELECT {by}, {wlo} AS w_lo, {whi} AS w_hi, {clo} AS c_lo, {chi} AS c_hi, {qlo} AS quad_lo, {qhi} AS quad_hi
    FROM {name}_q GROUP BY {by})"""


@query("e3_bootstrap_ols", f"""{BASE}, {_fits()} SELECT condition, round(w_lo, 6) AS w_lo, round(w_hi, 6) AS w_hi,
  round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi FROM b_ci""")
def e3_bootstrap_ols(t):
    return rounded(E.ols_interval(E.supply_cells(t.audited(), ["condition"]), ["condition"]).drop("quad_lo", "quad_hi"))


# The classical scheme: n slots per draw, each hashed to one of the group's runs, which rank by the digest of their id.
def _slots(draws: int = 2000) -> str:
    return f"""{BASE}, mu AS MATERIALIZED (SELECT condition, x, y, row_number() OVER g - 1 AS j, count(*) OVER (PARTITION BY condition) AS n
    FROM use WINDOW g AS (PARTITION BY condition ORDER BY md5(run_id::VARCHAR), run_id)),
  sl AS (SELECT condition, draw, ('0x' || substr(md5(concat_ws('|', '0', draw::VARCHAR, j::VARCHAR)), 1, 15))::BIGINT % n AS j
    FROM mu CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw)),
  md AS (SELECT sl.condition, draw, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy
    FROM sl JOIN mu ON mu.condition IS NOT DISTINCT FROM sl.condition AND mu.j = sl.j GROUP BY 1, 2),
  mv AS (SELECT condition, {K.slope()} AS w, {K.intercept()} AS c FROM md),
  mq AS (SELECT condition, {K.ci("w", draws=draws)[0]} AS w_lo, {K.ci("w", draws=draws)[1]} AS w_hi,
    {K.ci("c", draws=draws)[0]} AS c_lo, {K.ci("c", draws=draws)[1]} AS c_hi FROM mv GROUP BY condition)"""


@query("e3_bootstrap_multinomial", f"""{_slots()} SELECT condition, round(w_lo, 6) AS w_lo, round(w_hi, 6) AS w_hi,
  round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi FROM mq""")
def e3_bootstrap_multinomial(t):
    return rounded(E.ols_interval_classical(t.audited(), ["condition"], ["run_id"]))


@query("e3_bootstrap_multinomial_full", f"""{_slots()} SELECT condition, round(w_lo, 6) AS w_lo, round(w_hi, 6) AS w_hi,
  round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi FROM mq""")
def e3_bootstrap_multinomial_full(t):
    """The same: both have the operator's default draws."""
    return rounded(E.ols_interval_classical(t.audited(), ["condition"], ["run_id"]))


@query("e4_bootstrap_quadratic", f"""{BASE}, {_fits()} SELECT condition, round(quad_lo, 6) AS quad_lo,
  round(quad_hi, 6) AS quad_hi FROM b_ci""")
def e4_bootstrap_quadratic(t):
    return rounded(E.ols_interval(E.supply_cells(t.audited(), ["condition"]), ["condition"]).select(
        "condition", "quad_lo", "quad_hi"))


def cards(by: str = "condition", fits: str | None = None, src: str = "use", p: str = "") -> str:
    """CTE chain ending in `{p}card`: the shrinkage table per group."""
    name = f"{p}b"
    nf = len(FAMS)
    return f"""{fits or _fits(by, src, name)},
  {p}st AS MATERIALIZED (SELECT {by}, x, count(*) AS m, avg(y) AS my FROM {src} GROUP BY 1, 2),
  {p}per AS (SELECT {by}, count(*) AS levels, CASE WHEN regr_syy(my, x) > 1e-12 THEN regr_r2(my, x) END AS r2_strata,
     coalesce(max(CASE WHEN x = 0 THEN m END), 0) AS zero_n, max(x)::INT AS max_supply,
     coalesce(string_agg(CASE WHEN m < 10 THEN x END::VARCHAR, ',' ORDER BY x), '') AS thin FROM {p}st GROUP BY 1),
  {p}sm AS (SELECT {by}, {SUMS} FROM {src} GROUP BY 1),
  {p}raw AS (SELECT s.{by}, s.n AS n_runs, levels, levels >= 3 AND s.n >= 10 AS identifiable,
     {K.slope('s.n', 's.sx', 's.sy', 's.sxx', 's.sxy')} AS w, {K.intercept('s.n', 's.sx', 's.sy', 's.sxx', 's.sxy')} AS c,
     {K.r2('s.n', 's.sx', 's.sy', 's.sxx', 's.sxy', 's.syy')} AS r2_runs, r2_strata, {K.quad()} AS quad,
     w_lo, w_hi, c_lo, c_hi, quad_lo, quad_hi, zero_n, max_supply, thin
     FROM {p}sm s JOIN {p}per USING ({by}) LEFT JOIN {name}_ci USING ({by})),
  {p}guard AS (SELECT *, identifiable AND coalesce(w_hi - w_lo, 1e300) > 0.35 AS weak,
     identifiable AND zero_n < 5 AS extrapolated,
     identifiable AND coalesce(quad_lo > 0 OR quad_hi < 0, false) AS curved FROM {p}raw),
  {p}card AS MATERIALIZED (SELECT {by}, n_runs, levels,
     {', '.join(f'CASE WHEN identifiable THEN {c} END AS {c}' for c in
                ('w', 'w_lo', 'w_hi', 'c', 'c_lo', 'c_hi', 'r2_runs', 'r2_strata', 'quad', 'quad_lo', 'quad_hi'))},
     zero_n, max_supply, thin, identifiable, weak, extrapolated, curved,
     curved AND quad < 0 AND max_supply >= {nf - 1} AS ceiling,
     CASE WHEN NOT identifiable THEN 'unidentifiable' WHEN weak THEN 'weakly identified'
       WHEN extrapolated THEN 'c extrapolated' WHEN w >= 0.85 AND c <= 0.15 THEN 'faithful transduction'
       WHEN w <= 0.15 THEN 'pure register' ELSE 'shrinkage' END AS verdict FROM {p}guard)"""


CARD_OUT = ("n_runs, levels, round(w, 6) AS w, round(w_lo, 6) AS w_lo, round(w_hi, 6) AS w_hi, round(c, 6) AS c, "
            "round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi, round(r2_runs, 6) AS r2_runs, round(r2_strata, 6) AS r2_strata, "
            "round(quad, 6) AS quad, round(quad_lo, 6) AS quad_lo, round(quad_hi, 6) AS quad_hi, zero_n, max_supply, thin, "
            "identifiable, weak, extrapolated, curved, ceiling, verdict")


@query("e5_shrinkage", f"{BASE}, {cards()} SELECT condition, {CARD_OUT} FROM card")
def e5_shrinkage(t):
    return rounded(E.shrinkage(t.audited(), ["condition"], families=len(FAMS)))


@query("e6_strata", f"""{BASE} SELECT writer_id, x::INT AS supply, count(*) AS n, round(avg(y), 6) AS mean_emitted
  FROM use GROUP BY 1, 2""")
def e6_strata(t):
    return rounded(E.strata(t.audited(), ["writer_id"]))


@query("e7_prediction", f"""{BASE}, s AS (SELECT condition, {SUMS} FROM use GROUP BY 1),
  f AS (SELECT condition, {K.slope()} AS w, {K.intercept()} AS c FROM s)
  SELECT condition, round(w * 2 + c, 6) AS at_two, round(CASE WHEN w > 0 THEN (1 - w) / w END, 6) AS prior_trust,
   round(CASE WHEN w + c > 0 THEN (w * 4 + c) / (w + c) END / 4, 6) AS compression FROM f""")
def e7_prediction(t):
    f = E.ols(t.audited().where(~F.col("floor_guard")).select(
        "condition", F.col("supply").cast("double").alias("x"), F.col("emitted").cast("double").alias("y")),
        "x", "y", ["condition"])
    return rounded(f.select("condition", E.predict("slope", "intercept", 2).alias("at_two"),
                            E.prior_trust("slope").alias("prior_trust"),
                            E.compression("slope", "intercept", 1.0, 4.0).alias("compression")))


def _nr(v: str, q: float) -> str:
    """Nearest rank with banker's rounding."""
    return f"list_sort(list({v}))[round_even({q} * (count({v}) - 1), 0)::BIGINT + 1]"


_TOK = "len(regexp_extract_all({}, '\\S+'))"
_m8 = K.mask(K.ascii_text("s"), LEX)


@query("e8_span_fraction", f"""WITH {K.DEALT}, o AS MATERIALIZED (SELECT run_id, condition, output FROM runs WHERE length(output) >= 200),
  s AS (SELECT run_id, unnest({K.sents('output')}) AS s FROM o),
  h AS (SELECT run_id, sum(CASE WHEN {_m8} <> 0 THEN length(s) ELSE 0 END) AS hc,
     sum(CASE WHEN {_m8} <> 0 THEN {_TOK.format('s')} ELSE 0 END) AS ht FROM s GROUP BY 1),
  v AS (SELECT condition, hc / length(output)::DOUBLE AS f, ht / greatest(1, {_TOK.format('output')})::DOUBLE AS ft FROM o JOIN h USING (run_id)),
  g AS (SELECT condition, count(*) AS n_runs, median(f) AS med, {_nr('f', 0.25)} AS p25, {_nr('f', 0.75)} AS p75,
     median(ft) AS mt, count(*) FILTER (f = 0) AS z FROM v GROUP BY 1)
  SELECT condition, n_runs, round(med, 6) AS f_median, round(p25, 6) AS f_p25, round(p75, 6) AS f_p75,
   round(mt, 6) AS f_median_tokens, round(CASE WHEN med > 0 THEN 1 / med END, 6) AS dilution, z > n_runs * 0.5 AS mostly_zero,
   CASE WHEN med >= 0.5 THEN 'low dilution' ELSE 'high dilution' END AS verdict FROM g""")
def e8_span_fraction(t):
    return rounded(E.span_fraction(t.runs, LEX))


_wlo, _whi = K.wilson("wk", "wn")
CLEAN = """cc AS MATERIALIZED (SELECT condition, prompt_id, writer_id, x AS supply, count(*) AS n, count(*) FILTER (inv = 0) AS k, sum(inv) AS inv
    FROM use GROUP BY 1, 2, 3, 4),
  cs AS (SELECT condition, supply, sum(n) AS n, sum(k) AS k, sum(inv) AS inv, sum(k) / sum(n)::DOUBLE AS p FROM cc GROUP BY 1, 2),
  cr AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY (n >= 5) DESC, p, supply) AS rn,
     max((n >= 5)::INT) OVER (PARTITION BY condition) AS any5 FROM cs),
  cg AS (SELECT condition, sum(n) AS n_runs, sum(k) / sum(n)::DOUBLE AS p0, sum(inv) / sum(n)::DOUBLE AS lam FROM cs GROUP BY 1),
  worst AS MATERIALIZED (SELECT condition, n_runs, p0, lam, supply AS worst_supply, p AS p_worst, k AS wk, n AS wn, any5 = 0 AS thin
     FROM cg JOIN cr USING (condition) WHERE rn = 1)"""


@query("e10_clean_rate", f"""{BASE}, {CLEAN} SELECT condition, n_runs::BIGINT AS n_runs, round(p0, 6) AS p0, round(lam, 6) AS lam,
  round(exp(-lam), 6) AS poisson_p0, worst_supply::INT AS worst_supply, round(p_worst, 6) AS p_worst,
  round({_wlo}, 6) AS p_worst_lo, round({_whi}, 6) AS p_worst_hi, thin FROM worst""")
def e10_clean_rate(t):
    return rounded(E.clean_rate(t.audited()))


def _miss(n: int) -> str:
    return " * ".join(f"(greatest(n - k - {i}, 0) / (n - {i})::DOUBLE)" for i in range(n))


BON = f"""{CLEAN},
  pt AS ({' UNION ALL '.join(f"SELECT condition, supply, {n} AS draws, 1 - {_miss(n)} AS hit FROM cc WHERE n >= 2 AND n >= {n}" for n in range(1, 7))}),
  ow AS (SELECT w.condition, count(p.hit) > 0 AS own FROM worst w LEFT JOIN pt p ON p.condition = w.condition AND p.supply = w.worst_supply AND p.draws = 1 GROUP BY 1),
  em AS (SELECT p.condition, p.draws, avg(hit) AS empirical, count(*) AS cells FROM pt p JOIN worst w USING (condition) JOIN ow USING (condition)
     WHERE NOT own OR p.supply = w.worst_supply GROUP BY 1, 2),
  bon AS MATERIALIZED (SELECT w.condition, d.draws, 1 - pow(1 - p_worst, d.draws) AS independent, empirical, coalesce(cells, 0) AS cells, NOT own AS pooled
     FROM worst w JOIN ow USING (condition) CROSS JOIN (SELECT unnest(range(1, 7))::INT AS draws) d
     LEFT JOIN em ON em.condition = w.condition AND em.draws = d.draws)"""


@query("e11_best_of_n", f"""{BASE}, {BON} SELECT condition, draws, round(independent, 6) AS independent,
  round(empirical, 6) AS empirical, cells, pooled FROM bon""")
def e11_best_of_n(t):
    return rounded(E.best_of_n(t.audited()))


@query("e11_draws_needed", f"""{BASE}, {BON}, one AS (SELECT condition, independent AS p, cells AS base FROM bon WHERE draws = 1),
  gr AS (SELECT o.*, d.draws, b.empirical, b.cells FROM one o CROSS JOIN (SELECT unnest(range(1, 33))::INT AS draws) d
     LEFT JOIN bon b ON b.condition = o.condition AND b.draws = d.draws),
  hh AS (SELECT *, base > 0 AND coalesce(cells >= base * 0.5, false) AND empirical IS NOT NULL AS seen FROM gr),
  ht AS (SELECT *, CASE WHEN seen THEN empirical >= 0.95 ELSE 1 - pow(1 - p, draws) >= 0.95 END AS hit FROM hh)
  SELECT condition, coalesce(min(draws) FILTER (hit), -1)::INT AS n_needed,
   coalesce(arg_min(CASE WHEN seen THEN 'empirical' ELSE 'independence' END, draws) FILTER (hit), 'unreachable') AS basis FROM ht GROUP BY 1""")
def e11_draws_needed(t):
    return E.draws_needed(t.audited())


_l12, _h12 = K.wilson("k", "n")


@query("e12_wilson", f"""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS k
   FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, n, k, round({_l12}, 6) AS lo, round({_h12}, 6) AS hi FROM g""")
def e12_wilson(t):
    g = t.read("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") >= 0.05).alias("k"))
    lo, hi = S.wilson("k", "n")
    return rounded(g.select("*", lo.alias("lo"), hi.alias("hi")))


@query("e13_quantiles", f"""SELECT o_orderpriority, count(*) AS n, round(median(o_totalprice), 4) AS med,
  round({_nr('o_totalprice', 0.25)}, 4) AS p25, round({_nr('o_totalprice', 0.75)}, 4) AS p75, round({_nr('o_totalprice', 0.9)}, 4) AS p90
  FROM orders GROUP BY 1""")
def e13_quantiles(t):
    """Exact median and nearest-rank quartiles of order totals, by running counts."""
    return rounded(R.quantiles(t.read("orders"), ["o_orderpriority"], "o_totalprice",
                               {"med": "median", "p25": 0.25, "p75": 0.75, "p90": 0.9}).drop("zeros"), 4)


def _e14() -> str:
    rules = ["floor_ceil", "truncate", "fixed"]
    cols = ", ".join(f"round({K.ci('y / n', r)[i]}, 6) AS {r}_{s}" for r in rules for i, s in ((0, "lo"), (1, "hi")))
    return f"""{BASE}, {K.boot('b', '(SELECT writer_id, y FROM use)', ['writer_id'], ['y'])} SELECT writer_id, {cols} FROM b GROUP BY 1"""


@query("e14_interval_rules", _e14())
def e14_interval_rules(t):
    """The index rules of percentile intervals side by side, on the mean emitted per writer."""
    from ledgerloom.operators.bootstrap import draws_of

    use = t.audited().where(~F.col("floor_guard")).select("writer_id", F.col("emitted").cast("bigint").alias("y"))
    packed = draws_of(use, ["writer_id"], ["y"]).groupBy("writer_id").agg(
        F.sort_array(F.collect_list(S.ratio("y", "n"))).alias("v"))
    cols = []
    for r in ("floor_ceil", "truncate", "fixed"):
        lo, hi = S.interval("v", r)
        cols += [lo.alias(f"{r}_lo"), hi.alias(f"{r}_hi")]
    return rounded(packed.select("writer_id", *cols))


def diff_sql(p: str, src: str, draws: int = 2000) -> str:
    """CTEs ending in {p}d: every arm against src0 on mean inventions."""
    lo, hi = K.ci("a.inv / nullif(a.n, 0) - r.inv / nullif(r.n, 0)", "truncate", draws)
    return f"""{K.boot(p + 'b', f'(SELECT condition, inv FROM {src})', ['condition'], ['inv'], draws=draws)},
  {p}ci AS (SELECT a.condition, {lo} AS diff_lo, {hi} AS diff_hi FROM {p}b a JOIN {p}b r ON r.draw = a.draw AND r.condition = 'src0'
     WHERE a.condition <> 'src0' GROUP BY 1),
  {p}lam AS (SELECT condition, count(*) AS n, avg(inv) AS lam, count(*) FILTER (inv > 0) AS runs_with_invention FROM {src} GROUP BY 1),
  {p}d AS MATERIALIZED (SELECT l.condition, l.n, z.n AS n_baseline, l.lam, z.lam AS lam_baseline, diff_lo, diff_hi, l.runs_with_invention,
     CASE WHEN diff_lo IS NULL THEN 'not evaluable' WHEN diff_hi < 0 THEN 'lower than baseline'
       WHEN diff_lo > 0 THEN 'higher than baseline' ELSE 'not distinguishable' END AS verdict
     FROM {p}lam l JOIN {p}ci USING (condition) CROSS JOIN (SELECT * FROM {p}lam WHERE condition = 'src0') z)"""


DIFF_OUT = ("condition, n, n_baseline, round(lam, 6) AS lam, round(lam_baseline, 6) AS lam_baseline, round(diff_lo, 6) AS diff_lo, "
            "round(diff_hi, 6) AS diff_hi, runs_with_invention, verdict")


@query("e15_compare_arms", f"{BASE}, {diff_sql('m', 'use', 5000)} SELECT {DIFF_OUT} FROM md")
def e15_compare_arms(t):
    return rounded(E.mean_difference(t.audited(), "src0"))


_AUD2 = K.audited("prose_loose", "aud2")


@query("e16_two_instrument", f"""{BASE}, {_AUD2}, use2 AS (SELECT condition, n_inv::BIGINT AS inv FROM aud2 WHERE NOT floored),
  {diff_sql('m', 'use', 5000)}, {diff_sql('s', 'use2', 5000)},
  j AS (SELECT p.condition, p.diff_lo AS p_lo, p.diff_hi AS p_hi, q.diff_lo AS s_lo, q.diff_hi AS s_hi,
    p.diff_lo > 0 OR p.diff_hi < 0 AS pd, q.diff_lo > 0 OR q.diff_hi < 0 AS sd FROM md p JOIN sd q USING (condition))
  SELECT condition, round(p_lo, 6) AS p_lo, round(p_hi, 6) AS p_hi, round(s_lo, 6) AS s_lo, round(s_hi, 6) AS s_hi,
   CASE WHEN pd AND sd AND (p_hi < 0) = (s_hi < 0) THEN 'confirmed' WHEN pd AND sd THEN 'contradictory'
     WHEN pd THEN 'instrument-relative' WHEN sd THEN 'secondary only' ELSE 'none' END AS verdict FROM j""")
def e16_two_instrument(t):
    return rounded(E.two_instrument(E.mean_difference(t.audited("prose"), "src0"), E.mean_difference(t.audited("prose_loose"), "src0")))


_SHARED = """na AS (SELECT count(DISTINCT source) AS n FROM documents),
  sh AS (SELECT doc_id % 7 AS prompt_id FROM documents GROUP BY 1 HAVING count(DISTINCT source) = (SELECT n FROM na))"""


@query("e17_comparable", f"""WITH {_SHARED}, pr AS (SELECT DISTINCT source AS condition, doc_id % 7 AS prompt_id FROM documents),
  p AS (SELECT condition, count(*) AS prompts, count(*) FILTER (prompt_id NOT IN (SELECT prompt_id FROM sh)) AS own_prompts FROM pr GROUP BY 1),
  w AS (SELECT source AS condition, count(DISTINCT lang) AS writers FROM documents GROUP BY 1)
  SELECT condition, prompts, own_prompts, writers, own_prompts = 0 AND writers <= 1 AS comparable FROM p JOIN w USING (condition)""")
def e17_comparable(t):
    return E.check_comparable(t.documents.select(
        F.col("source").alias("condition"), (F.col("doc_id") % 7).alias("prompt_id"), F.col("lang").alias("writer_id")))


@query("e17_restrict_shared", f"""WITH {_SHARED} SELECT source AS condition, count(*) AS n FROM documents
  WHERE doc_id % 7 IN (SELECT prompt_id FROM sh) GROUP BY 1""")
def e17_restrict_shared(t):
    runs = t.documents.select(F.col("source").alias("condition"), (F.col("doc_id") % 7).alias("prompt_id"))
    return E.restrict_to_shared(runs).groupBy("condition").agg(F.count("*").alias("n"))


def _e18() -> str:
    lo, hi = K.ci("d / nullif(n, 0)", "fixed", 5000)
    return f"""WITH it AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS a,
      arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1),
  u AS MATERIALIZED (SELECT 1 AS g, o_custkey, round(a - b, 2)::DOUBLE AS d FROM it WHERE a IS NOT NULL AND b IS NOT NULL),
  {K.boot('bb', 'u', ['g'], ['d'], key=['o_custkey'], draws=5000)},
  c AS (SELECT {lo} AS lo, {hi} AS hi FROM bb), p AS (SELECT count(*) AS items, avg(d) AS diff FROM u)
  SELECT items, round(diff, 3) AS diff, round(lo, 3) AS diff_lo, round(hi, 3) AS diff_hi,
   CASE WHEN items >= 10 THEN 'evaluable' ELSE 'not evaluable' END AS status FROM p CROSS JOIN c"""


@query("e18_paired_difference", _e18())
def e18_paired_difference(t):
    """Order totals per customer as items, status F against O, last order of each."""
    o = t.read("orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_totalprice").alias("score"))
    return rounded(E.paired_difference(o, "o_custkey", "o_orderstatus", "o_orderkey", "F", "O"), 3)


def _cluster_sql(src: str, cluster: str, by: str, a: str, b: str, draws: int = 2000, rule: str = "truncate", places: int = 6) -> str:
    """src has columns by, cluster, arm, num."""
    lo, hi = K.ci("na / nullif(da, 0) - nb / nullif(db, 0)", rule, draws)
    return f"""un AS MATERIALIZED (SELECT {by}, {cluster}, sum(CASE WHEN arm = '{a}' THEN num ELSE 0 END)::DOUBLE AS na,
     (count(*) FILTER (arm = '{a}'))::DOUBLE AS da, sum(CASE WHEN arm = '{b}' THEN num ELSE 0 END)::DOUBLE AS nb,
     (count(*) FILTER (arm = '{b}'))::DOUBLE AS db FROM {src} WHERE arm IN ('{a}', '{b}') GROUP BY 1, 2),
  {K.boot('bo', 'un', [by], ['na', 'da', 'nb', 'db'], key=[cluster], draws=draws)},
  ci AS (SELECT {by}, {lo} AS lo, {hi} AS hi FROM bo GROUP BY 1),
  po AS (SELECT {by}, count(*) AS clusters, sum(na) AS na, sum(da) AS da, sum(nb) AS nb, sum(db) AS db FROM un GROUP BY 1),
  jj AS (SELECT *, da > 0 AND db > 0 AS us FROM po LEFT JOIN ci USING ({by})),
  cd AS MATERIALIZED (SELECT {by}, clusters, round(na / nullif(da, 0), {places}) AS rate_a, round(nb / nullif(db, 0), {places}) AS rate_b,
   round(CASE WHEN us THEN na / nullif(da, 0) - nb / nullif(db, 0) END, {places}) AS diff, round(CASE WHEN us THEN lo END, {places}) AS diff_lo,
   round(CASE WHEN us THEN hi END, {places}) AS diff_hi, CASE WHEN NOT us OR lo IS NULL THEN 'not evaluable'
     WHEN lo > 0 OR hi < 0 THEN 'distinguishable' ELSE 'not distinguishable' END AS status FROM jj)"""


@query("e19_cluster_difference", f"""{BASE}, sr AS (SELECT 1 AS g, prompt_id, writer_id AS arm, (inv > 0)::INT AS num FROM use),
  {_cluster_sql('sr', 'prompt_id', 'g', 'en', 'fr')} SELECT clusters, rate_a, rate_b, diff, diff_lo, diff_hi, status FROM cd""")
def e19_cluster_difference(t):
    """Invention rate of two writers, clustered by prompt."""
    a = t.audited().where(~F.col("floor_guard")).select(
        F.lit(1).alias("g"), "prompt_id", F.col("writer_id").alias("arm"), (F.col("n_invented") > 0).cast("int").alias("num"))
    return rounded(E.cluster_difference(a, "prompt_id", "arm", "en", "fr", "num", by=["g"]).drop("g"))


def _e20() -> str:
    lo, hi = K.ci(K.slope("m"))
    return f"""{BASE}, un AS MATERIALIZED (SELECT writer_id, prompt_id, count(*)::DOUBLE AS m, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy,
     sum(x*x)::DOUBLE AS sxx, sum(x*y)::DOUBLE AS sxy FROM use GROUP BY 1, 2),
  {K.boot('bo', 'un', ['writer_id'], ['m', 'sx', 'sy', 'sxx', 'sxy'], key=['prompt_id'])},
  ci AS (SELECT writer_id, {lo} AS lo, {hi} AS hi FROM bo GROUP BY 1),
  po AS (SELECT writer_id, count(*) AS clusters, sum(m) AS m, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM un GROUP BY 1)
  SELECT writer_id, clusters, m::BIGINT AS n, round({K.slope('m')}, 6) AS slope, round(lo, 6) AS slope_lo, round(hi, 6) AS slope_hi
  FROM po LEFT JOIN ci USING (writer_id)"""


@query("e20_cluster_slope", _e20())
def e20_cluster_slope(t):
    return rounded(E.cluster_slope(t.audited().where(~F.col("floor_guard")), "prompt_id", "supply", "emitted", ["writer_id"]))


def _e20d() -> str:
    sl = {g: K.slope(f"m{g}", f"sx{g}", f"sy{g}", f"sxx{g}", f"sxy{g}") for g in "ab"}
    lo, hi = K.ci(f"({sl['a']} - {sl['b']})")
    cols = [f"{c}{g}" for g in "ab" for c in ("m", "sx", "sy", "sxx", "sxy")]
    e = {"m": "1", "sx": "x", "sy": "y", "sxx": "x*x", "sxy": "x*y"}
    aggs = ", ".join(f"sum(CASE WHEN writer_id = '{w}' THEN {v} ELSE 0 END)::DOUBLE AS {k}{g}"
                     for g, w in (("a", "en"), ("b", "de")) for k, v in e.items())
    return f"""{BASE}, un AS MATERIALIZED (SELECT * FROM (SELECT 1 AS g, prompt_id, {aggs} FROM use GROUP BY 1, 2) WHERE ma > 0 AND mb > 0),
  {K.boot('bo', 'un', ['g'], cols, key=['prompt_id'])}, ci AS (SELECT {lo} AS lo, {hi} AS hi FROM bo),
  po AS (SELECT count(*) AS clusters, {', '.join(f'sum({c}) AS {c}' for c in cols)} FROM un)
  SELECT clusters, round({sl['a']} - {sl['b']}, 6) AS diff, round(lo, 6) AS diff_lo, round(hi, 6) AS diff_hi FROM po CROSS JOIN ci"""


@query("e20_slope_difference", _e20d())
def e20_slope_difference(t):
    return rounded(E.slope_difference(t.audited().where(~F.col("floor_guard")), "prompt_id", "supply", "emitted",
                                      "writer_id", "en", "de"))


def _e21() -> str:
    lo, hi = K.ci("v", "truncate", 5000)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS fam, writer_id, {ch} AS ch, ({K.count('t', [p])} > 0)::INT AS e FROM tx"
        for f, pats in lexicon(LEX).items() if len(pats) > 1 for ch, p in ((1, pats[0]), (0, pats[1])))
    m = lambda t, c: f"sum(CASE WHEN tt = {t} AND ch = {c} THEN %s END) / nullif(sum(CASE WHEN tt = {t} AND ch = {c} THEN %s END), 0)"
    did = lambda a, b: f"(({m(1, 1)} - {m(0, 1)}) - ({m(1, 0)} - {m(0, 0)}))" % ((a, b) * 4)
    return f"""WITH tx AS MATERIALIZED (SELECT lang AS writer_id, {K.ascii_text('text')} AS t FROM documents WHERE lang IN ('en', 'de')),
  ev AS MATERIALIZED (SELECT fam, (writer_id = 'de')::INT AS tt, ch, e FROM ({rows})),
  {K.boot('bo', 'ev', ['fam', 'tt', 'ch'], ['e'], draws=5000)},
  pd AS (SELECT fam, draw, {did('e', 'n')} AS v FROM bo GROUP BY 1, 2),
  ci AS (SELECT fam, {lo} AS lo, {hi} AS hi FROM pd GROUP BY 1),
  po AS (SELECT fam, {did('e', '1.0::DOUBLE')} AS did, coalesce(sum(CASE WHEN ch = 0 THEN e END), 0)::BIGINT AS events FROM ev GROUP BY 1)
  SELECT fam AS family, events, round(CASE WHEN events >= 5 THEN did END, 6) AS did, round(CASE WHEN events >= 5 THEN lo END, 6) AS did_lo,
   round(CASE WHEN events >= 5 THEN hi END, 6) AS did_hi, CASE WHEN events < 5 OR lo IS NULL THEN 'not evaluable' WHEN lo > 0 THEN 'signature'
     ELSE 'not distinguishable' END AS status FROM po LEFT JOIN ci USING (fam)"""


@query("e21_difference_in_differences", _e21())
def e21_did(t):
    """First against second phrasing of each family, German against English documents."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(ch).alias("ch"), X.has("text", p).cast("int").alias("event"))
            for f, pats in lexicon(LEX).items() if len(pats) > 1 for ch, p in ((1, pats[0]), (0, pats[1]))]
    ev = t.documents.where(F.col("lang").isin("en", "de")).select("lang", F.explode(F.array(*rows)).alias("e")).select(
        "lang", "e.*")
    return rounded(E.difference_in_differences(ev, "family", "lang", "de", "en", "ch"))


META = """mu_use AS (SELECT w AS e, pow((w_hi - w_lo) / 3.92, 2) AS v FROM card WHERE n_runs >= 30 AND identifiable AND w_lo IS NOT NULL AND w_hi > w_lo),
  mu_fe AS (SELECT count(*) AS k, sum(1 / v) AS sw, sum(e / v) AS swe, sum(e * e / v) AS swee, sum(1 / (v * v)) AS sww FROM mu_use),
  mu_t AS (SELECT k, CASE WHEN sw - sww / sw > 1e-12 THEN greatest(0.0, (swee - swe * swe / sw - (k - 1)) / (sw - sww / sw)) ELSE 0.0 END AS tau2 FROM mu_fe),
  mu_re AS (SELECT max(k) AS k, max(tau2) AS tau2, sum(1 / (v + tau2)) AS sw, sum(e / (v + tau2)) AS swe FROM mu_use CROSS JOIN mu_t)"""


@query("e22_meta", f"""{BASE}, {cards()}, {META} SELECT k, round(swe / sw, 6) AS mu, round(sqrt(1 / sw), 6) AS se,
  round(swe / sw - 1.96 * sqrt(1 / sw), 6) AS mu_lo, round(swe / sw + 1.96 * sqrt(1 / sw), 6) AS mu_hi, round(sqrt(tau2), 6) AS tau,
  round(swe / sw - 1.96 * sqrt(tau2 + 1 / sw), 6) AS pi_lo, round(swe / sw + 1.96 * sqrt(tau2 + 1 / sw), 6) AS pi_hi FROM mu_re""")
def e22_meta(t):
    return rounded(E.meta(E.shrinkage(t.audited(), ["condition"])))


def _icc(k, n, sn2, sx, ssb, sxx) -> str:
    k, n, sn2, sx, ssb, sxx = (f"{v}::DOUBLE" for v in (k, n, sn2, sx, ssb, sxx))
    msb = f"(CASE WHEN {k} > 1 THEN ({ssb} - {sx} * {sx} / {n}) / ({k} - 1) END)"
    msw = f"(CASE WHEN {n} > {k} THEN ({sxx} - {ssb}) / ({n} - {k}) ELSE 0.0 END)"
    n0 = f"(({n} - {sn2} / {n}) / ({k} - 1))"
    den = f"({msb} + ({n0} - 1) * {msw})"
    return f"(CASE WHEN {den} > 1e-12 THEN ({msb} - {msw}) / {den} WHEN {den} IS NOT NULL THEN 0.0 END)"


def _e23() -> str:
    lo, hi = K.ci(_icc("n", "g", "gg", "s", "b", "q"), "fixed")
    boot = K.boot("bo", "cl", ["one"], ["g", "s", "q", "gg", "b"])
    # a cell is identified by group size, sum and sum of squares
    boot = boot.replace("concat_ws('|', coalesce(one::VARCHAR, '~'), coalesce(g::VARCHAR, '~'), coalesce(s::VARCHAR, '~'), "
                        "coalesce(q::VARCHAR, '~'), coalesce(gg::VARCHAR, '~'), coalesce(b::VARCHAR, '~'))",
                        "concat_ws('|', one::VARCHAR, g::VARCHAR, s::VARCHAR, q::VARCHAR)")
    return f"""{BASE}, gr AS MATERIALIZED (SELECT prompt_id, writer_id, count(*) AS g, sum(inv) AS sx, sum(inv * inv) AS sxx FROM use GROUP BY 1, 2 HAVING count(*) >= 2),
  cl AS MATERIALIZED (SELECT 1 AS one, g, sx::BIGINT AS s, sxx::BIGINT AS q, g * g AS gg, sx::DOUBLE * sx / g AS b FROM gr), {boot},
  ci AS (SELECT {lo} AS lo, {hi} AS hi FROM bo),
  po AS (SELECT count(*) AS groups, sum(g)::BIGINT AS runs, sum(gg) AS gg, sum(s) AS s, sum(b) AS b, sum(q) AS q FROM cl)
  SELECT groups, runs, round({_icc('groups', 'runs', 'gg', 's', 'b', 'q')}, 6) AS icc, round(lo, 6) AS icc_lo, round(hi, 6) AS icc_hi FROM po CROSS JOIN ci"""


@query("e23_icc", _e23())
def e23_icc(t):
    return rounded(E.icc(t.audited().where(~F.col("floor_guard")), ["prompt_id", "writer_id"], "n_invented"))


@query("e23_dispersion", f"""{BASE}, g AS (SELECT writer_id, x AS supply, count(*) AS n, avg(inv) AS m, var_samp(inv) AS v FROM use GROUP BY 1, 2)
  SELECT writer_id, supply::INT AS supply, n, round(m, 6) AS mean, round(v, 6) AS var, round(v / m, 6) AS index FROM g WHERE n >= 15 AND m > 0""")
def e23_dispersion(t):
    return rounded(E.dispersion(t.audited().where(~F.col("floor_guard")), ["writer_id", "supply"], "n_invented"))


def _e24() -> str:
    cols = ["sx", "sxx"] + [f"{k}{i}" for i in range(len(FAMS)) for k in ("y", "xy")]
    sel = "x AS sx, x*x AS sxx, " + ", ".join(
        f"((present & {1 << i}) <> 0)::BIGINT AS y{i}, ((present & {1 << i}) <> 0)::BIGINT * x AS xy{i}" for i in range(len(FAMS)))
    boot = K.boot("bo", "cl", ["one"], ["m", *cols])
    ident = "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in ["one", "m", *cols]) + ")"
    boot = boot.replace(ident, "concat_ws('|', one::VARCHAR, sx::VARCHAR, m::VARCHAR)")
    sh = [f"(CASE WHEN n::DOUBLE * sxx - sx::DOUBLE * sx > 1e-9 THEN (n::DOUBLE * xy{i} - sx::DOUBLE * y{i}) / (n::DOUBLE * sxx - sx::DOUBLE * sx) END)"
          for i in range(len(FAMS))]
    cis = [K.ci(e, "fixed") for e in sh]
    slope = " + ".join(sh)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS family, round({sh[i]}, 6) AS share, round(lo{i}, 6) AS share_lo, round(hi{i}, 6) AS share_hi, round({slope}, 6) AS slope FROM po CROSS JOIN ci"
        for i, f in enumerate(FAMS))
    return f"""{BASE}, cl AS MATERIALIZED (SELECT 1 AS one, present AS m, {sel} FROM use), {boot},
  ci AS (SELECT {', '.join(f'{lo} AS lo{i}, {hi} AS hi{i}' for i, (lo, hi) in enumerate(cis))} FROM bo),
  po AS (SELECT count(*) AS n, {', '.join(f'sum({c}) AS {c}' for c in cols)} FROM cl) {rows}"""


@query("e24_slope_decomposition", _e24())
def e24_slope_decomposition(t):
    return rounded(E.decompose_slope(t.audited(), LEX))


def _v10() -> str:
    rows = " UNION ALL ".join(f"SELECT '{k}' AS stage, {a}::BIGINT AS x, {b}::BIGINT AS y FROM tr"
                              for k, a, b in (("first", "s", "l"), ("second", "l", "o"), ("direct", "s", "o")))
    get = ", ".join(f"max({c}) FILTER (stage = '{k}') AS {k}_{c}" for k in ("first", "second", "direct")
                    for c in ("w", "c", "w_lo", "w_hi", "c_lo", "c_hi"))
    return f"""WITH {K.DEALT}, tr AS (SELECT bit_count({K.mask(K.ascii_text("alpha || ' ' || beta"), LEX)}) AS s,
    bit_count({K.mask(K.ascii_text('gamma'), LEX)}) AS l, bit_count({K.mask(K.ascii_text('output'), LEX)}) AS o FROM runs),
  lg AS MATERIALIZED ({rows}), {_fits('stage', 'lg')},
  ft AS (SELECT stage, {K.slope()} AS w, {K.intercept()} AS c FROM (SELECT stage, {SUMS} FROM lg GROUP BY 1)),
  g AS (SELECT {get} FROM ft LEFT JOIN b_ci USING (stage)),
  h AS (SELECT *, first_w * second_w AS pw, second_w * first_c + second_c AS pc FROM g)
  SELECT {', '.join(f'round({k}_{c}, 6) AS {k}_{c}' for k in ('first', 'second', 'direct') for c in 'wc')}, round(pw, 6) AS predicted_w,
   round(pc, 6) AS predicted_c, pw BETWEEN direct_w_lo AND direct_w_hi AS w_inside, pc BETWEEN direct_c_lo AND direct_c_hi AS c_inside,
   CASE WHEN pw BETWEEN direct_w_lo AND direct_w_hi AND pc BETWEEN direct_c_lo AND direct_c_hi THEN 'supported' ELSE 'falsified' END AS status FROM h"""


@query("v10_stage_composition", _v10())
def v10_stage_composition(t):
    n = lambda e: F.bit_count(X.families_mask(e, LEX))
    tr = t.dealt.select(n(F.concat("alpha", F.lit(" "), "beta")).alias("s"), n("gamma").alias("l"), n("output").alias("o"))
    return rounded(E.stage_composition(tr, "s", "l", "o"))


def _e36(draws: int = 2000) -> str:
    return f"""WITH d AS MATERIALIZED (SELECT lang, doc_id, {K.total(K.ascii_text('text'), LEX)} / length(text)::DOUBLE * 1000 AS dn FROM documents WHERE length(text) > 0),
  {K.boot('bo', 'd', ['lang'], ['dn'], key=['doc_id'], draws=draws)},
  ci AS (SELECT lang, {K.ci('dn / nullif(n, 0)', 'truncate', draws)[0]} AS lo, {K.ci('dn / nullif(n, 0)', 'truncate', draws)[1]} AS hi FROM bo GROUP BY 1),
  po AS (SELECT lang, count(*) AS n, avg(dn) AS mean FROM d GROUP BY 1)
  SELECT lang, n, round(mean, 5) AS mean, round(lo, 5) AS mean_lo, round(hi, 5) AS mean_hi FROM po JOIN ci USING (lang)"""


@query("e36_mean_interval", _e36())
def e36_mean_interval(t):
    """Density per language with a document bootstrap."""
    d = t.documents.where(F.length("text") > 0).select(
        "lang", "doc_id", (X.total_count("text", LEX) / F.length("text") * 1000).alias("dn"))
    out = E.mean_interval(d, ["lang"], ["doc_id"], "dn")
    return rounded(out.select("lang", "n", "mean", F.col("mean_lo"), F.col("mean_hi")), 5)


query("e36_mean_interval_full", _e36())(e36_mean_interval)


@query("e40_decorrelation", f"""{BASE}, j AS (SELECT prompt_id, supply::INT AS s, count(*) AS c FROM aud GROUP BY 1, 2),
  pm AS (SELECT prompt_id, sum(c) AS a FROM j GROUP BY 1), sm AS (SELECT s, sum(c) AS b FROM j GROUP BY 1),
  n AS (SELECT sum(c) AS n, count(DISTINCT prompt_id) AS n_prompts FROM j),
  mi AS (SELECT sum(c / n::DOUBLE * ln(c::DOUBLE * n / (a * b)::DOUBLE)) AS mi FROM j JOIN pm USING (prompt_id) JOIN sm USING (s) CROSS JOIN n),
  h AS (SELECT -sum(b / n::DOUBLE * ln(b / n::DOUBLE)) AS hs, max(b) AS big, min(b) AS small, count(*) AS levels FROM sm CROSS JOIN n)
  SELECT n::BIGINT AS n_items, n_prompts, levels, round(CASE WHEN hs > 0 THEN mi / hs ELSE 0 END, 6) AS nmi,
   CASE WHEN hs > 0 THEN mi / hs ELSE 0 END < 0.15 AS balanced, big > 3 * greatest(1, small) AS imbalanced, n < 1000 AS small
  FROM n CROSS JOIN mi CROSS JOIN h""")
def e40_decorrelation(t):
    return rounded(E.decorrelation(t.audited()))


@query("e51_corner_verdict", f"""{BASE}, {cards('writer_id')}, sx AS (SELECT writer_id, x, my, lag(my) OVER (PARTITION BY writer_id ORDER BY x) AS pv FROM st),
  mo AS (SELECT writer_id, bool_and(coalesce(my >= pv - 0.05, true)) AS monotone FROM sx GROUP BY 1)
  SELECT writer_id, round(w_lo, 6) AS w_lo, round(w_hi, 6) AS w_hi, round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi, monotone,
   CASE WHEN NOT identifiable OR w_lo IS NULL THEN 'unidentifiable'
    WHEN weak OR extrapolated OR NOT monotone OR w_hi <= 0.15 OR (w_lo >= 0.85 AND c_hi <= 0.15) THEN 'falsified'
    WHEN w_lo > 0.15 AND NOT (w_lo >= 0.85 AND c_hi <= 0.15) AND (w_hi < 0.85 OR c_lo > 0.15) AND c_lo > 0 THEN 'supported'
    ELSE 'partial' END AS status FROM card JOIN mo USING (writer_id)""")
def e51_corner_verdict(t):
    a = t.audited()
    return rounded(E.corner_verdict(E.shrinkage(a, ["writer_id"]), E.strata(a, ["writer_id"]), ["writer_id"]))


@query("e52_arm_sweep", f"""{BASE}, {cards()}, {diff_sql('m', 'use', 5000)}
  SELECT c.condition, n_runs, round(w, 6) AS w, round(c, 6) AS c,
   CASE WHEN NOT identifiable THEN 'unidentifiable' WHEN weak THEN 'weak' WHEN extrapolated THEN 'extrapolated' ELSE 'comparable' END AS status,
   round(diff_lo, 6) AS diff_lo, round(diff_hi, 6) AS diff_hi, m.verdict AS against_baseline
  FROM card c LEFT JOIN md m ON m.condition = c.condition""")
def e52_arm_sweep(t):
    a = t.audited()
    card = E.shrinkage(a, ["condition"])
    diff = E.mean_difference(a, "src0").select("condition", "diff_lo", "diff_hi", F.col("verdict").alias("against_baseline"))
    status = F.when(~F.col("identifiable"), "unidentifiable").when(F.col("weak"), "weak").when(
        F.col("extrapolated"), "extrapolated").otherwise("comparable")
    return rounded(card.join(diff, "condition", "left").select(
        "condition", "n_runs", "w", "c", status.alias("status"), "diff_lo", "diff_hi", "against_baseline"))


@query("e53_null_classes", f"""{BASE}, {diff_sql('m', 'use', 5000)} SELECT condition, round(diff_lo, 6) AS diff_lo, round(diff_hi, 6) AS diff_hi,
  CASE WHEN diff_lo > 0 OR diff_hi < 0 THEN 'not a null' WHEN diff_lo IS NULL OR runs_with_invention = 0 OR runs_with_invention = n THEN 'degenerate'
   WHEN runs_with_invention < 5 THEN 'uninformative' WHEN diff_hi >= 0.1 OR diff_lo <= -0.1 THEN 'weak' ELSE 'informative' END AS null_class FROM md""")
def e53_null_classes(t):
    d = E.mean_difference(t.audited(), "src0")
    return rounded(E.classify_null(d, fired="runs_with_invention").select("condition", "diff_lo", "diff_hi", "null_class"))
