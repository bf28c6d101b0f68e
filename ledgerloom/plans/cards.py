"""System report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import cards as C
from ledgerloom.operators import detection as D
from ledgerloom.operators import estimators as E
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded
from ledgerloom.plans.detection import SEATS, STRICT, _dn, _fd
from ledgerloom.plans.estimators import BASE, BON, CLEAN, _TOK, _m8, cards
from ledgerloom.plans.hygiene import CALLS, calls
from ledgerloom.operators import hygiene as P

LEX = "prose"
FAMS = list(lexicon(LEX))
W = f"WITH {K.DEALT}"
INS = {"loose": "b", "strict": "c"}


def _probes(t):
    return t.documents.select(X.families_mask("text", "prose").alias("truth_mask"), X.families_mask("text", "prose_loose").alias("b"),
                              X.families_mask("text", STRICT).alias("c"))


_PM = f"""WITH pm AS MATERIALIZED (SELECT {K.mask('t', 'prose')} AS tr, {K.mask('t', 'prose_loose')} AS b, {K.mask('t', STRICT)} AS c FROM (SELECT {K.ascii_text('text')} AS t FROM documents)),
  ms AS (SELECT 'loose' AS instrument, sum(bit_count({K.minus('tr', 'b')})::INT)::BIGINT AS missed, sum(bit_count(tr)::INT)::BIGINT AS total FROM pm
    UNION ALL SELECT 'strict', sum(bit_count({K.minus('tr', 'c')})::INT)::BIGINT, sum(bit_count(tr)::INT)::BIGINT FROM pm)"""
_blo, _bhi = K.wilson("missed", "total")


@query("e9_blindspot", f"{_PM} SELECT instrument, missed, total, round(missed / total::DOUBLE, 6) AS miss_rate, round({_blo}, 6) AS lo, round({_bhi}, 6) AS hi FROM ms")
def e9_blindspot(t):
    return rounded(C.blindspot(_probes(t), INS))


@query("e9_joint_miss", f"{_PM}, r AS (SELECT missed / total::DOUBLE AS m FROM ms) SELECT count(*) AS instruments, round(CASE WHEN min(m) > 0 THEN product(m) ELSE 0 END, 6) AS joint FROM r")
def e9_joint_miss(t):
    return rounded(C.joint_miss(C.blindspot(_probes(t), INS)))


@query("e9_disagreement", f"""{_PM}, g AS (SELECT 'loose' AS a, 'strict' AS b, sum(bit_count(xor(pm.b, pm.c))::INT)::BIGINT AS differ, sum(bit_count(pm.b | pm.c)::INT)::BIGINT AS "union" FROM pm)
  SELECT *, round(differ / "union"::DOUBLE, 6) AS disagreement, differ / "union"::DOUBLE < 0.1 AS near_duplicate FROM g""")
def e9_disagreement(t):
    return rounded(C.disagreement(_probes(t), INS))


@query("e35_spearman", f"""{BASE}, g AS (SELECT condition, round(avg(x), 9) AS mx, round(avg(y), 9) AS my FROM use GROUP BY 1),
  r AS (SELECT rank() OVER (ORDER BY mx) + (count(*) OVER (PARTITION BY mx) - 1) / 2.0 AS rx, rank() OVER (ORDER BY my) + (count(*) OVER (PARTITION BY my) - 1) / 2.0 AS ry FROM g)
  SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def e35_spearman(t):
    """Rank correlation of mean supply and mean emitted over arms (one row per arm)."""
    g = t.audited().where(~F.col("floor_guard")).groupBy("condition").agg(
        F.round(F.avg("supply"), 9).alias("mx"), F.round(F.avg("emitted"), 9).alias("my"))
    return rounded(C.spearman(g, "mx", "my"))


_fin = " UNION ALL ".join(f"SELECT '{f}' AS family, avg({K.count('o', ps)} / length(o)::DOUBLE * 1000) AS fd FROM (SELECT {K.ascii_text('output')} AS o FROM runs WHERE output <> '')"
                          for f, ps in lexicon(LEX).items())


@query("e37_retention", f"""{W}, {SEATS}, fd AS ({_fd}), g AS (SELECT seat, family, round(avg(d), 9) AS d FROM fd GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY d DESC, seat) AS rn FROM g), f AS ({_fin})
  SELECT family, seat AS owner, round(d, 6) AS owner_density, round(fd, 6) AS final_density, round(CASE WHEN d > 0.01 THEN fd / d END, 6) AS retention
  FROM r JOIN f USING (family) WHERE rn = 1""")
def e37_retention(t):
    finals = t.dealt.where("output <> ''").select(F.col("output").alias("text"))
    return rounded(C.retention(t.seats, finals, LEX))


@query("e38_power", f"""{BASE}, g AS (SELECT avg(inv) FILTER (writer_id = 'en') AS ma, avg(inv) FILTER (writer_id = 'fr') AS mb, var_samp(inv) FILTER (writer_id = 'en') AS va, var_samp(inv) FILTER (writer_id = 'fr') AS vb FROM use),
  d AS (SELECT *, abs(ma - mb) / sqrt((va + vb) / 2) AS d FROM g)
  SELECT round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS d, ceil(2 * pow(1.959964 + 0.8416212, 2) / (d * d))::BIGINT AS n_per_arm FROM d""")
def e38_power(t):
    return rounded(C.power(t.audited().where(~F.col("floor_guard")), "writer_id", "en", "fr", "n_invented"))


@query("e38_effective_n", f"""{BASE}, g AS (SELECT writer_id, count(*) AS n, count(DISTINCT prompt_id) AS clusters FROM use GROUP BY 1)
  SELECT *, round(1 + (n / clusters::DOUBLE - 1) * 0.19, 6) AS design_effect, round(n / (1 + (n / clusters::DOUBLE - 1) * 0.19), 6) AS n_eff FROM g""")
def e38_effective_n(t):
    return rounded(C.effective_n(t.audited().where(~F.col("floor_guard")), ["writer_id"], "prompt_id"))


@query("e39_degeneracy", f"{W} SELECT condition, count(*) AS n, count(*) FILTER (length(output) < 800) AS short, count(*) FILTER (length(output) < 800) > count(*) / 2.0 AS dropped FROM runs GROUP BY 1")
def e39_degeneracy(t):
    return C.degeneracy(t.dealt, "condition", "output")


@query("e39_drop_degenerate", f"""{W}, d AS (SELECT condition FROM runs GROUP BY 1 HAVING count(*) FILTER (length(output) < 800) > count(*) / 2.0)
  SELECT condition, count(*) AS n FROM runs WHERE condition NOT IN (SELECT condition FROM d) GROUP BY 1""")
def e39_drop_degenerate(t):
    return C.drop_degenerate(t.dealt, "condition", "output").groupBy("condition").agg(F.count("*").alias("n"))


TUNED = {"src1": ("src0", "even"), "src3": ("src0", "even"), "src5": ("src2", "odd")}


def _e41() -> str:
    lo, hi = K.ci("na / nullif(da, 0) - nb / nullif(db, 0)", "truncate")
    long = " UNION ALL ".join(f"SELECT run_id, prompt_id, writer_id, '{f}' AS family, '{a}' AS tuned, CASE WHEN condition = '{a}' THEN 'tuned' ELSE 'base' END AS arm, v FROM sc WHERE condition IN ('{a}', '{b}')"
                              for a, (b, f) in TUNED.items())
    return f"""{W}, sc AS MATERIALIZED (SELECT run_id, prompt_id, condition, writer_id, round({_dn('output')}, 6) AS v FROM runs), lg AS MATERIALIZED ({long}),
  un AS MATERIALIZED (SELECT family, tuned, prompt_id, sum(CASE WHEN arm = 'tuned' THEN v ELSE 0 END)::DOUBLE AS na, (count(*) FILTER (arm = 'tuned'))::DOUBLE AS da,
     sum(CASE WHEN arm = 'base' THEN v ELSE 0 END)::DOUBLE AS nb, (count(*) FILTER (arm = 'base'))::DOUBLE AS db FROM lg WHERE writer_id = 'en' GROUP BY 1, 2, 3),
  {K.boot('bo', 'un', ['family', 'tuned'], ['na', 'da', 'nb', 'db'], key=['prompt_id'])},
  ci AS (SELECT family, tuned, {lo} AS lo, {hi} AS hi FROM bo GROUP BY 1, 2),
  po AS (SELECT family, tuned, sum(na) / sum(da) - sum(nb) / sum(db) AS d FROM un GROUP BY 1, 2),
  of AS (SELECT family, tuned, avg(v) FILTER (arm = 'tuned' AND writer_id <> 'en') - avg(v) FILTER (arm = 'base' AND writer_id <> 'en') AS o FROM lg GROUP BY 1, 2),
  dl AS MATERIALIZED (SELECT family, tuned, d, lo, hi, o, CASE WHEN lo > 0 THEN 'positive' WHEN hi < 0 THEN 'negative' ELSE 'spans zero' END AS sign
     FROM po JOIN ci USING (family, tuned) JOIN of USING (family, tuned))"""


def _deltas(t):
    r = t.dealt.select("prompt_id", "condition", "writer_id", F.round(D.density("output", LEX), 6).alias("v"))
    return C.lineage(r, TUNED, "prompt_id", "condition", "writer_id", "v", "en")


@query("e41_lineage", f"{_e41()} SELECT family, tuned, round(d, 4) AS delta_in, round(lo, 4) AS diff_lo, round(hi, 4) AS diff_hi, round(o, 4) AS delta_off, sign, abs(d) > 2 * abs(o) AS domain_specific FROM dl")
def e41_lineage(t):
    return rounded(_deltas(t), 4)


@query("e41_lineage_verdict", f"""{_e41()}, p AS (SELECT family, bool_and(sign = 'positive') AS pos, bool_and(sign = 'negative') AS neg FROM dl GROUP BY 1)
  SELECT count(*) AS lineages, count(*) FILTER (pos) AS positive, count(*) FILTER (neg) AS negative, CASE WHEN count(*) < 2 THEN 'not evaluable' WHEN count(*) FILTER (pos) = count(*) THEN 'replicated'
   WHEN count(*) FILTER (neg) = count(*) THEN 'replicated negative' ELSE 'not replicated' END AS verdict FROM p""")
def e41_lineage_verdict(t):
    return C.lineage_verdict(_deltas(t))


@query("e45_silence", f"""WITH {K.DEALT}, {K.audited(LEX)} SELECT condition, count(*) AS n, round(avg(chars), 6) AS mean_chars, round(avg(emitted), 6) AS mean_emitted,
   count(*) FILTER (emitted = 0) AS silent, round(avg(floored::INT), 6) AS floor_rate FROM aud GROUP BY 1""")
def e45_silence(t):
    return rounded(C.silence(t.audited(), ["condition"]))


@query("e46_mode_summary", """SELECT user_id, event_type, count(*) AS runs, count(*) FILTER (value <= 100) AS completed, count(*) FILTER (value > 100) AS failed, round(sum(value), 2) AS latency,
   round(avg(length(props)), 6) AS mean_size, sum(floor(value * 100)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2""")
def e46_mode_summary(t):
    e = t.read("events").select("user_id", "event_type", "value", F.length("props").alias("size"), F.floor(F.col("value") * 100).cast("bigint").alias("tok"),
                                (F.col("value") > 100).alias("bad"))
    m = C.mode_summary(e, ["user_id", "event_type"], "value", "size", "tok", "bad")
    return rounded(m.withColumn("latency", F.round("latency", 2)))


_USABLE = f"""WITH {K.DEALT.replace("runs AS MATERIALIZED", "all_runs AS MATERIALIZED")}, runs AS MATERIALIZED (SELECT * FROM all_runs WHERE length(output) >= 500 AND up <> ''), {K.audited(LEX)},
  use AS MATERIALIZED (SELECT run_id, condition, writer_id, prompt_id, supply::BIGINT AS x, emitted::BIGINT AS y, n_inv::BIGINT AS inv FROM aud WHERE NOT floored)"""
CARDS = f"""{_USABLE}, {cards()}, {BON}, one AS (SELECT condition, independent AS p, cells AS base FROM bon WHERE draws = 1),
  gr AS (SELECT o.*, d.draws, b.empirical, b.cells FROM one o CROSS JOIN (SELECT unnest(range(1, 33))::INT AS draws) d LEFT JOIN bon b ON b.condition = o.condition AND b.draws = d.draws),
  hh AS (SELECT *, base > 0 AND coalesce(cells >= base * 0.5, false) AND empirical IS NOT NULL AS seen FROM gr),
  ht AS (SELECT *, CASE WHEN seen THEN empirical >= 0.95 ELSE 1 - pow(1 - p, draws) >= 0.95 END AS hit FROM hh),
  nd AS (SELECT condition, coalesce(min(draws) FILTER (hit), -1)::INT AS n_needed, coalesce(arg_min(CASE WHEN seen THEN 'empirical' ELSE 'independence' END, draws) FILTER (hit), 'unreachable') AS basis FROM ht GROUP BY 1),
  sn AS (SELECT run_id, unnest({K.sents('output')}) AS s FROM runs), hs AS (SELECT run_id, sum(CASE WHEN {_m8} <> 0 THEN length(s) ELSE 0 END) AS hc FROM sn GROUP BY 1),
  fv AS (SELECT condition, hc / length(output)::DOUBLE AS f FROM runs JOIN hs USING (run_id)), fm AS (SELECT condition, median(f) AS med FROM fv GROUP BY 1),
  su AS (SELECT condition, count(*) AS supplied FROM all_runs GROUP BY 1), us AS (SELECT condition, count(*) AS used FROM runs GROUP BY 1),
  cx AS MATERIALIZED (SELECT su.condition, supplied, coalesce(used, 0) AS used, w, w_lo, w_hi, c, c_lo, c_hi, coalesce(verdict, 'no usable records') AS verdict,
     coalesce(identifiable, false) AS identifiable, p0, lam, worst_supply::INT AS worst_supply, p_worst, n_needed, basis, med AS f_median, CASE WHEN med > 0 THEN 1 / med END AS dilution
     FROM su LEFT JOIN us USING (condition) LEFT JOIN card USING (condition) LEFT JOIN worst USING (condition) LEFT JOIN nd USING (condition) LEFT JOIN fm USING (condition))"""
_num = ("w", "w_lo", "w_hi", "c", "c_lo", "c_hi", "p0", "lam", "p_worst", "f_median", "dilution")


@query("e47_parameter_cards", f"{CARDS} SELECT condition, supplied, used, verdict, identifiable, worst_supply, n_needed, basis, {', '.join(f'round({c}, 6) AS {c}' for c in _num)} FROM cx")
def e47_parameter_cards(t):
    return rounded(C.parameter_cards(t.runs, LEX))


@query("e48_recommend", f"""{CARDS}, fa AS (SELECT *, coalesce(identifiable AND w >= 0.85 AND c <= 0.15, false) AS ff FROM cx)
  SELECT condition, concat_ws('; ', CASE WHEN ff THEN 'no intervention' END, CASE WHEN NOT ff AND n_needed > 0 THEN 'best of ' || n_needed END, CASE WHEN NOT ff AND n_needed < 0 THEN 'selection insufficient' END,
    CASE WHEN NOT ff AND f_median < 0.5 THEN 'minimal pairs with masked loss' END, CASE WHEN NOT ff THEN 'counterfactual corpus' END, CASE WHEN NOT ff THEN 'steering unavailable' END) AS recommendations FROM fa""")
def e48_recommend(t):
    r = C.recommend(C.parameter_cards(t.runs, LEX), can_train=True)
    return r.select("condition", F.array_join("recommendations", "; ").alias("recommendations"))


BOUNDS = {"w": (0.1, 0.8), "c": (0.2, 1.5), "p0": (0.4, 1.0)}


@query("e49_selftest", f"""{_USABLE}, {cards()}, {CLEAN}, j AS (SELECT c.condition, w, c, p0 FROM card c LEFT JOIN worst USING (condition)),
  l AS (SELECT condition, 'w' AS metric, w AS value, 0.1 AS lo, 0.8 AS hi FROM j UNION ALL SELECT condition, 'c', c, 0.2, 1.5 FROM j UNION ALL SELECT condition, 'p0', p0, 0.4, 1.0 FROM j)
  SELECT condition, metric, round(value, 6) AS value, lo::DOUBLE AS lo, hi::DOUBLE AS hi, CASE WHEN value IS NULL THEN 'missing' WHEN value BETWEEN lo AND hi THEN 'ok' ELSE 'out of range' END AS status FROM l""")
def e49_selftest(t):
    usable, _ = P.partition(t.runs)
    from ledgerloom.operators import provenance as V

    a = V.audit(usable, LEX)
    j = E.shrinkage(a, ["condition"]).select("condition", "w", "c").join(E.clean_rate(a).select("condition", "p0"), "condition", "left")
    return rounded(C.selftest(j, BOUNDS))


_ex = "translate(substr(output, 1, 180), chr(10) || '|', ' /')"


@query("e50_ledger_report", f"""{W}, x AS (SELECT run_id, prompt_id, length(output) AS chars, {_dn('output')} AS dens, bit_count({K.mask(K.ascii_text('output'), LEX)})::INT AS k, CASE WHEN alpha <> '' THEN {_dn('alpha')} END AS sd, {_ex} AS excerpt FROM runs)
  SELECT run_id, prompt_id, chars::INT AS chars, round(dens, 6) AS density, round(dens * sqrt(k / 6::DOUBLE), 6) AS composite, round(sd, 6) AS seat_density, excerpt FROM x""")
def e50_ledger_report(t):
    return rounded(C.ledger_report(t.dealt, "alpha", LEX, ["run_id", "prompt_id"]))


@query("e54_gate_density", f"""{W}, x AS (SELECT condition, prompt_id % 5 = 0 AS fr, CASE WHEN alpha <> '' THEN {_dn('alpha')} END AS d FROM runs)
  SELECT condition, count(*) FILTER (fr) AS gate_runs, round(avg(coalesce(d, 0)) FILTER (fr), 6) AS gate_density, count(d) FILTER (NOT fr) AS seat_runs, round(avg(d) FILTER (NOT fr), 6) AS seat_density FROM x GROUP BY 1""")
def e54_gate_density(t):
    turns = t.dealt.select("condition", (F.col("prompt_id") % 5 == 0).alias("free"), F.when(F.col("alpha") != "", F.col("alpha")).alias("text"))
    return rounded(C.gate_density(turns, LEX, ["condition"], "free"))


@query("e56_gates", f"""{W}, r AS (SELECT condition, avg((length(output) >= 500)::INT) AS a, avg((up = '')::INT) AS b FROM runs GROUP BY 1),
  l AS (SELECT condition, 'compliance' AS metric, a AS rate, 0.7 AS bar, a >= 0.7 AS ok FROM r UNION ALL SELECT condition, 'attrition', b, 0.2, b < 0.2 FROM r)
  SELECT condition, metric, round(rate, 6) AS rate, bar::DOUBLE AS bar, CASE WHEN rate IS NULL THEN 'not evaluable' WHEN ok THEN 'proceed' ELSE 'stop' END AS decision FROM l""")
def e56_gates(t):
    up = F.concat("alpha", "beta", "gamma") == ""
    g = t.dealt.groupBy("condition").agg(F.avg((F.length("output") >= 500).cast("int")).alias("a"), F.avg(up.cast("int")).alias("b"))
    rates = g.select("condition", F.explode(F.array(F.struct(F.lit("compliance").alias("metric"), F.col("a").alias("rate")),
                                                    F.struct(F.lit("attrition").alias("metric"), F.col("b").alias("rate")))).alias("e")).select("condition", "e.*")
    return rounded(C.gate(rates, {"compliance": (">=", 0.7), "attrition": ("<", 0.2)}))


@query("o1_union_corpora", """SELECT 'doc:' || source AS condition, count(*) AS runs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1
  UNION ALL SELECT 'chat:' || role, count(*), sum(length(text))::BIGINT FROM conversations GROUP BY 1""")
def o1_union_corpora(t):
    """Two corpora unioned by name under relabelled conditions."""
    a = t.read("documents").select(F.concat(F.lit("doc:"), "source").alias("condition"), "text", "lang")
    b = t.read("conversations").select(F.concat(F.lit("chat:"), "role").alias("condition"), "text")
    return a.unionByName(b, allowMissingColumns=True).groupBy("condition").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"))


@query("o2_shared_keys", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def o2_shared_keys(t):
    """Keys two arms share, by one counted pass instead of an intersection of two scans."""
    o = t.read("orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("k")).where("k = 2").select("o_custkey")


@query("o3_missing_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def o3_missing_keys(t):
    return t.read("customer").select("c_custkey").join(t.read("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("j2_optional_labels", """SELECT lang, count(*) AS docs, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def j2_optional_labels(t):
    """Labels that may be absent stay null."""
    return t.read("documents").select("doc_id", "lang").join(t.read("labels"), "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))


@query("w2_running_cost", f"""WITH {CALLS}, d AS (SELECT ledger_id, ts::DATE AS day, sum(cost) AS c FROM cost GROUP BY 1, 2)
  SELECT ledger_id, day::VARCHAR AS day, round(sum(c) OVER (PARTITION BY ledger_id ORDER BY day), 4)::DOUBLE AS spent FROM d""")
def w2_running_cost(t):
    """Running spend per ledger and day; calls are summed per day before the window sees them."""
    from pyspark.sql import Window

    d = P.call_cost(calls(t)).groupBy("ledger_id", F.to_date("ts").alias("day")).agg(F.sum("cost").alias("c"))
    w = Window.partitionBy("ledger_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("ledger_id", F.col("day").cast("string").alias("day"), F.round(F.sum("c").over(w), 4).cast("double").alias("spent"))
