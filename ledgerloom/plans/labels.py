"""Label, agreement and preference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import detection as D
from ledgerloom.operators import estimators as E
from ledgerloom.operators import labels as L
from ledgerloom.operators import ranks as R
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded

LEX = "prose"
FAMS = list(lexicon(LEX))
SENT = f"""WITH se AS MATERIALIZED (SELECT doc_id, source, lang, s, pos, {K.ascii_text('s')} AS t FROM (
    SELECT doc_id, source, lang, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM (SELECT *, {K.sents('text')} AS ss FROM documents)))"""


def sentence_labels(t):
    """Two judges label every sentence: the strict and the loose detector; one reply in seventeen is unusable."""
    s = t.sentences.select("doc_id", "pos", X.families_mask("s", "prose").alias("one"), X.families_mask("s", "prose_loose").alias("two"))
    lost = (F.col("doc_id") + F.col("pos")) % 17 == 0
    each = F.explode(F.array(*[
        F.struct(F.lit(j).alias("judge"), F.lit(f).alias("family"), (F.when(~lost, X.mask_has(j, i)) if j == "two" else X.mask_has(j, i)).alias("value"))
        for j in ("one", "two") for i, f in enumerate(FAMS)]))
    return s.select("doc_id", "pos", each.alias("e")).select("doc_id", "pos", "e.*")


_lab = " UNION ALL ".join(
    f"SELECT doc_id, pos, '{f}' AS family, (m1 & {1 << i}) <> 0 AS a, CASE WHEN (doc_id + pos) % 17 <> 0 THEN (m2 & {1 << i}) <> 0 END AS b FROM ms"
    for i, f in enumerate(FAMS))
LABELS = f"""{SENT}, ms AS MATERIALIZED (SELECT doc_id, pos, {K.mask('t', 'prose')} AS m1, {K.mask('t', 'prose_loose')} AS m2 FROM se), lb AS ({_lab})"""


@query("e28_agreement", f"""{LABELS} SELECT family, count(*) AS decisions, count(b) AS usable, count(*) FILTER (a = b) AS agree,
  count(*) FILTER (a AND b) AS both_yes, count(*) FILTER (NOT a AND NOT b) AS both_no, round(count(*) FILTER (a = b) / count(b)::DOUBLE, 6) AS rate,
  CASE WHEN count(*) FILTER (a = b) / count(b)::DOUBLE >= 0.7 THEN 'pass' ELSE 'fail' END AS gate FROM lb GROUP BY 1""")
def e28_agreement(t):
    return rounded(L.agreement(sentence_labels(t), ["doc_id", "pos", "family"], "one", "two"))


@query("e28_both_agree", f"""{LABELS} SELECT doc_id, count(*) FILTER (a AND b) AS yes, count(*) FILTER (NOT a AND NOT b) AS no,
  count(*) FILTER (b IS NULL OR a <> b) AS unlabelled FROM lb GROUP BY 1""")
def e28_both_agree(t):
    b = L.both_agree(sentence_labels(t), ["doc_id", "pos", "family"], "one", "two")
    return b.groupBy("doc_id").agg(F.count_if(F.col("label")).alias("yes"), F.count_if(~F.col("label")).alias("no"),
                                   F.count_if(F.col("label").isNull()).alias("unlabelled"))


def scored_labels(t):
    """Labelled documents with a score in [0, 1]: match density over 50."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars", F.round(F.least(D.density("text", LEX) / 50, F.lit(1.0)), 6).alias("score"))
    return d.join(t.read("labels"), "doc_id")


_SCORE = f"""sc AS MATERIALIZED (SELECT doc_id, lang, source, n_chars, quality, toxic, round(least(dn / 50, 1.0), 6) AS score FROM (
   SELECT *, CASE WHEN length(text) > 0 THEN {K.total(K.ascii_text('text'), LEX)} / length(text)::DOUBLE * 1000 ELSE 0 END AS dn FROM documents) JOIN labels USING (doc_id))"""


def _auc_sql(by: str, src: str) -> str:
    """Rank-sum form with average ranks."""
    return f"""ra AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS rk FROM {src}),
  au AS (SELECT {by}, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
     (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)) END AS auc FROM ra GROUP BY 1)"""


def _youden_sql(by: str, src: str) -> str:
    return f"""cd AS (SELECT DISTINCT {by}, round(score, 4) AS c FROM {src} UNION SELECT DISTINCT {by}, v FROM {src}, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) x(v)),
  yj AS (SELECT c.{by}, c.c, round(count(*) FILTER (y = 1 AND score >= c.c) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE
     - count(*) FILTER (y = 0 AND score >= c.c) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE, 12) AS j, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q
     FROM cd c JOIN {src} s ON s.{by} = c.{by} GROUP BY 1, 2),
  yr AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY j DESC, c) AS rn FROM yj),
  yo AS (SELECT {by}, p AS n_pos, q AS n_neg, CASE WHEN p >= 5 AND q >= 5 THEN c END AS cut, CASE WHEN p >= 5 AND q >= 5 THEN j END AS j FROM yr WHERE rn = 1)"""


@query("e26_auc", f"WITH {_SCORE}, y AS (SELECT lang, quality AS y, score FROM sc), {_auc_sql('lang', 'y')} SELECT lang, n_pos, n_neg, round(auc, 6) AS auc FROM au")
def e26_auc(t):
    return rounded(R.auc(scored_labels(t), ["lang"], "quality", "score"))


@query("e27_youden", f"WITH {_SCORE}, y AS (SELECT lang, quality AS y, score FROM sc), {_youden_sql('lang', 'y')} SELECT lang, n_pos, n_neg, round(cut, 6) AS cut, round(j, 6) AS j FROM yo")
def e27_youden(t):
    return rounded(R.youden(scored_labels(t), ["lang"], "quality", "score"))


@query("e57_calibrate", f"""WITH {_SCORE}, l AS (SELECT 'quality' AS family, doc_id, source, quality AS y, score FROM sc UNION ALL SELECT 'toxic', doc_id, source, toxic, score FROM sc),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, source ORDER BY doc_id) AS r FROM l) WHERE r <= 15),
  {_auc_sql('family', 'k')}, {_youden_sql('family', 'k')}
  SELECT family, a.n_pos, a.n_neg, round(auc, 6) AS auc, round(cut, 6) AS cut, round(j, 6) AS j FROM au a JOIN yo USING (family)""")
def e57_calibrate(t):
    """AUC and cut per label from the first fifteen labelled documents of each source."""
    s = scored_labels(t)
    each = F.explode(F.array(F.struct(F.lit("quality").alias("family"), F.col("quality").alias("y")),
                             F.struct(F.lit("toxic").alias("family"), F.col("toxic").alias("y"))))
    long = s.select("doc_id", "source", "score", each.alias("e")).select("doc_id", "source", "score", "e.*")
    return rounded(R.calibrate(long, "family", "source", "doc_id", "y", "score", cap=15))


@query("e29_judge_accuracy", f"""WITH {_SCORE}, a AS (SELECT 'length' AS judge, CASE WHEN doc_id % 19 <> 0 THEN n_chars >= 1000 END AS v, quality = 1 AS tr FROM sc
    UNION ALL SELECT 'density', CASE WHEN doc_id % 23 <> 0 THEN score >= 0.3 END, quality = 1 FROM sc)
  SELECT judge, count(*) AS asked, count(v) AS answered, count(*) FILTER (v = tr) AS "right", round(count(*) FILTER (v = tr) / count(v)::DOUBLE, 6) AS accuracy,
   round((count(*) - count(v)) / count(*)::DOUBLE, 6) AS failure_rate, CASE WHEN count(*) FILTER (v = tr) / count(v)::DOUBLE >= 0.8 THEN 'pass' ELSE 'fail' END AS gate FROM a GROUP BY 1""")
def e29_judge_accuracy(t):
    s = scored_labels(t)
    each = F.explode(F.array(
        F.struct(F.lit("length").alias("judge"), F.when(F.col("doc_id") % 19 != 0, F.col("n_chars") >= 1000).alias("value")),
        F.struct(F.lit("density").alias("judge"), F.when(F.col("doc_id") % 23 != 0, F.col("score") >= 0.3).alias("value"))))
    labels = s.select("doc_id", each.alias("e")).select("doc_id", "e.*")
    truth = t.read("labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    return rounded(L.judge_accuracy(labels, truth, ["doc_id"]))


@query("e25_attenuation", f"""{LABELS}, c AS (SELECT doc_id, count(*) FILTER (m1 <> 0) AS a, count(*) FILTER (m2 <> 0) AS b, count(*) AS n FROM ms GROUP BY 1),
  g AS (SELECT count(*) AS units, corr(a, b) AS r, regr_slope(b, a) AS slope FROM c)
  SELECT units, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS reliability, round(slope, 6) AS slope, round(slope / (2 * r / (1 + r)), 6) AS disattenuated, 'evaluable' AS status FROM g""")
def e25_attenuation(t):
    """Flagged sentences per document by two judges."""
    c = t.sentences.select("doc_id", X.families_mask("s", "prose").alias("m1"), X.families_mask("s", "prose_loose").alias("m2")).groupBy("doc_id").agg(
        F.count_if(F.col("m1") != 0).cast("double").alias("a"), F.count_if(F.col("m2") != 0).cast("double").alias("b"))
    return rounded(L.attenuation(c, c.agg(F.regr_slope("b", "a").alias("slope"))))


# ---------------------------------------------------------------- replies

_K = "doc_id % 8"


@query("p12_decode_replies", f"""SELECT doc_id,
  CASE {_K} WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'B' WHEN 3 THEN 'A' END AS winner,
  CASE {_K} WHEN 0 THEN 'ONE' WHEN 1 THEN 'NEITHER' WHEN 3 THEN 'TWO' END AS position,
  CASE {_K} WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'DROPPED' END AS fate,
  CASE {_K} WHEN 0 THEN 'legal' WHEN 1 THEN 'OTHER' END AS consult,
  CASE {_K} WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE -1 END AS grade, CASE {_K} WHEN 0 THEN 4 WHEN 3 THEN 12 ELSE 0 END AS ref,
  CASE {_K} WHEN 0 THEN 'true,false' WHEN 1 THEN 'false,true' END AS booleans,
  CASE {_K} WHEN 0 THEN 'A' WHEN 1 THEN 'TIE' END AS verdict FROM documents""")
def p12_decode_replies(t):
    """Eight reply shapes per decoder, wrapped around each document's own text; malformed ones stay null."""
    k = F.col("doc_id") % 8
    think = F.concat(F.lit("<think>WINNER: A ONE RESOLVED "), "text", F.lit("</think>"))
    def shape(*forms):
        out = F.when(k == 0, forms[0])
        for i, f in enumerate(forms[1:], 1):
            out = out.when(k == i, f)
        return out.otherwise(F.lit(""))
    body = F.concat(F.lit("q "), F.regexp_replace("text", "(?i)\\b[ab]\\b", "x"), F.lit("\n"))
    lit = F.lit
    winner = shape(F.concat(body, lit("WINNER: A")), F.concat(lit("WINNER: A\n"), body, lit("winner: b")), F.concat(think, lit("The better one is B.")),
                   F.concat(body, lit("Response A")), F.concat(body, lit("A or B")), F.concat(body, lit("neither")))
    position = shape(lit("ONE"), lit("NEITHER of ONE and TWO"), lit("ONE TWO"), F.concat(think, lit("two.")), lit("none"))
    fate = shape(F.concat(think, lit("resolved")), lit("Dropped"), lit("RESOLVED and DROPPED"), lit("unclear"))
    consult = shape(F.concat(body, lit("CONSULT: finance\nCONSULT: legal")), lit("CONSULT: cooking"), lit("consult no one"))
    grade = shape(lit("VERBATIM\nREF: 4"), lit("**Close**: yes\nno number"), F.concat(lit("one\ntwo\nthree\nWEAK\n"), lit("end")), lit("none\nref 12 of 20"))
    bools = shape(lit('ok {"labels": {"x": true, "y": false}}'), F.concat(think, lit('{"x": false, "y": true, "note": "z"}')),
                  lit('{"x": "true", "y": false}'), lit('{"x": true}'), lit("{broken"))
    quote = F.to_json(F.struct(lit("A").alias("verdict"), F.array(F.substring(F.element_at(X.words("text"), 1), 1, 40)).alias("evidence_a"),
                               F.array().cast("array<string>").alias("evidence_b")))
    verdict = shape(quote, lit('{"verdict": "TIE"}'), lit('{"verdict": "C"}'), lit('{"verdict": "A", "evidence_a": ["this quote is surely not in there"]}'))
    d = t.documents.select("doc_id", "text", *[e.alias(n) for n, e in (
        ("w", winner), ("p", position), ("f", fate), ("c", consult), ("g", grade), ("b", bools), ("v", verdict))])
    m, gr = L.decode_booleans("b", ["x", "y"]), L.decode_grade("g")
    return d.select(
        "doc_id", L.decode_winner("w").alias("winner"), L.decode_position("p").alias("position"), L.decode_fate("f").alias("fate"),
        L.decode_consult("c", ["legal", "finance"]).alias("consult"), gr["grade"].alias("grade"), gr["ref"].alias("ref"),
        F.when(m.isNotNull(), F.concat_ws(",", m["x"].cast("string"), m["y"].cast("string"))).alias("booleans"),
        L.decode_verdict("v", "text", "text").alias("verdict"))


@query("p12_decode_batch", """SELECT doc_id, doc_id % 4 <> 3 AS parsed, CASE WHEN doc_id % 4 <> 3 THEN (n_chars > 1000)::VARCHAR || ',' || (lang = 'en')::VARCHAR END AS first_row FROM documents""")
def p12_decode_batch(t):
    """Numbered batch replies; an incomplete batch is null as a whole."""
    def row(a, b):
        return F.struct(a.alias("x"), b.alias("y"))
    one = row(F.col("n_chars") > 1000, F.col("lang") == "en")
    two = row(F.lit(True), F.when(F.col("doc_id") % 4 != 3, F.lit(False)))
    reply = F.concat(F.lit("Here: "), F.to_json(F.struct(one.alias("1"), two.alias("2"))))
    d = t.documents.select("doc_id", L.decode_batch(reply, 2, ["x", "y"]).alias("b"))
    first = F.get("b", F.lit(0))
    return d.select("doc_id", F.col("b").isNotNull().alias("parsed"),
                    F.when(F.col("b").isNotNull(), F.concat_ws(",", first["x"].cast("string"), first["y"].cast("string"))).alias("first_row"))


# ---------------------------------------------------------------- preference

def pairs(t):
    """Neighbouring documents as answer pairs with their lengths and match counts."""
    d = t.documents.select(F.floor(F.col("doc_id") / 2).alias("rep"), (F.col("doc_id") % 2).alias("side"), F.length("text").alias("len"),
                           X.total_count("text", LEX).alias("feat"))
    def of(side, col):
        return F.max(F.when(F.col("side") == side, F.col(col)))
    p = d.groupBy("rep").agg(of(0, "len").alias("len1"), of(1, "len").alias("len2"), of(0, "feat").alias("feat1"), of(1, "feat").alias("feat2"))
    p = p.where("len1 is not null and len2 is not null")
    return p.withColumn("comparison", F.concat(F.lit("C"), (F.col("rep") % 3).cast("string"))).withColumn("case_id", F.col("rep") % 40)


def judgments(t):
    """Two judges in both orders: one prefers length, one match count; some always answer A, some replies are lost."""
    rows = []
    for judge, a, b, bias in (("length", "len1", "len2", 5), ("matches", "feat1", "feat2", 7)):
        first = F.col(a) >= F.col(b)
        stuck = F.col("rep") % bias == 0
        rows.append(F.struct(F.lit(judge).alias("judge"), F.lit("fwd").alias("ordering"), F.when(stuck | first, "A").otherwise("B").alias("verdict")))
        rows.append(F.struct(F.lit(judge).alias("judge"), F.lit("rev").alias("ordering"),
                             F.when(F.col("rep") % 23 != 0, F.when(stuck | ~first, "A").otherwise("B")).alias("verdict")))
    keep = ["comparison", "case_id", "rep", "len1", "len2", "feat1", "feat2"]
    return pairs(t).select(*keep, F.explode(F.array(*rows)).alias("e")).select(*keep, "e.*")


PREF = f"""WITH dd AS (SELECT doc_id // 2 AS rep, doc_id % 2 AS side, length(text) AS len, {K.total(K.ascii_text('text'), LEX)} AS feat FROM documents),
  pr AS MATERIALIZED (SELECT *, 'C' || (rep % 3) AS comparison, rep % 40 AS case_id FROM (SELECT rep, max(len) FILTER (side = 0) AS len1, max(len) FILTER (side = 1) AS len2,
     max(feat) FILTER (side = 0) AS feat1, max(feat) FILTER (side = 1) AS feat2 FROM dd GROUP BY 1) WHERE len1 IS NOT NULL AND len2 IS NOT NULL),
  vd AS MATERIALIZED (SELECT *, CASE WHEN rep % 23 = 0 THEN NULL WHEN stuck THEN 'TIE' WHEN fst THEN 'S1' ELSE 'S2' END AS verdict FROM (
     SELECT *, 'length' AS judge, rep % 5 = 0 AS stuck, len1 >= len2 AS fst FROM pr UNION ALL SELECT *, 'matches', rep % 7 = 0, feat1 >= feat2 FROM pr))"""


@query("e31_pair_verdicts", f"{PREF} SELECT judge, rep, verdict FROM vd")
def e31_pair_verdicts(t):
    return L.pair_verdicts(judgments(t), ["judge", "rep"])


def _sign_sql(w: str, l: str) -> str:
    return f"""CASE WHEN {w} + {l} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(greatest({w}, {l})::BIGINT, ({w} + {l} + 1)::BIGINT),
     lambda i: exp(lgamma(({w} + {l} + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma(({w} + {l} - i + 1)::DOUBLE) - ({w} + {l}) * ln(2.0::DOUBLE))))) END"""


@query("e30_sign_test", f"""{PREF}, g AS (SELECT judge, comparison, count(*) AS n, count(*) FILTER (verdict = 'S1') AS s1, count(*) FILTER (verdict = 'S2') AS s2,
   count(*) FILTER (verdict = 'TIE') AS ties, count(*) FILTER (verdict IS NULL) AS invalid FROM vd GROUP BY 1, 2)
  SELECT *, round({_sign_sql('s1', 's2')}, 6) AS p_value FROM g""")
def e30_sign_test(t):
    return rounded(L.tallies(L.pair_verdicts(judgments(t), ["judge", "comparison", "rep"]), ["judge", "comparison"]))


def _win_sql(draws: int = 5000) -> str:
    lo, hi = K.ci("w / nullif(m, 0)", "truncate", draws)
    return f"""un AS MATERIALIZED (SELECT judge, comparison, case_id, (count(*) FILTER (verdict = 'S1'))::DOUBLE AS w, count(*)::DOUBLE AS m FROM vd
     WHERE verdict IN ('S1', 'S2') GROUP BY 1, 2, 3), {K.boot('bo', 'un', ['judge', 'comparison'], ['w', 'm'], key=['case_id'], draws=draws)},
  ci AS (SELECT judge, comparison, {lo} AS lo, {hi} AS hi FROM bo GROUP BY 1, 2),
  po AS (SELECT judge, comparison, sum(m)::BIGINT AS decisive, sum(w) / sum(m) AS share FROM un GROUP BY 1, 2),
  ws AS MATERIALIZED (SELECT judge, comparison, decisive, share, lo, hi, CASE WHEN lo > 0.5 THEN 'S1' WHEN hi < 0.5 THEN 'S2' ELSE 'spans' END AS side
     FROM po LEFT JOIN ci USING (judge, comparison))"""


@query("e32_win_share", f"""{PREF}, {_win_sql()} SELECT judge, comparison, decisive, round(share, 6) AS share, round(lo, 6) AS share_lo, round(hi, 6) AS share_hi, side FROM ws""")
def e32_win_share(t):
    return rounded(L.win_share(L.pair_verdicts(judgments(t), ["judge", "comparison", "case_id", "rep"]), ["judge", "comparison"], "case_id"))


@query("e32_replication", f"""{PREF}, {_win_sql()} SELECT p.comparison, p.side AS primary_side, s.side AS second_side,
   CASE WHEN s.side = 'spans' THEN 'not replicated' WHEN s.side = p.side THEN 'agrees' ELSE 'contradicts' END AS verdict
  FROM ws p JOIN ws s ON s.comparison = p.comparison AND s.judge = 'matches' WHERE p.judge = 'length'""")
def e32_replication(t):
    w = L.win_share(L.pair_verdicts(judgments(t), ["judge", "comparison", "case_id", "rep"]), ["judge", "comparison"], "case_id")
    return L.replication(w.where("judge = 'length'"), w.where("judge = 'matches'"), ["comparison"])


@query("e33_preference_drivers", f"""{PREF}, d AS (SELECT *, verdict = 'S1' AS s1, abs(len1 - len2) < 0.15 * greatest(len1, len2) AS mt FROM vd WHERE verdict IN ('S1', 'S2'))
  SELECT judge, comparison, count(*) AS decisive, round(count(*) FILTER (s1 = (len1 > len2)) / count(*)::DOUBLE, 6) AS winner_longer, count(*) FILTER (mt) AS length_matched,
   round(count(*) FILTER (mt AND s1) / nullif(count(*) FILTER (mt), 0)::DOUBLE, 6) AS matched_share, count(*) FILTER (feat1 <> feat2) AS feature_differs,
   round(count(*) FILTER (feat1 <> feat2 AND s1 = (feat1 > feat2)) / nullif(count(*) FILTER (feat1 <> feat2), 0)::DOUBLE, 6) AS winner_has_more FROM d GROUP BY 1, 2""")
def e33_preference_drivers(t):
    v = L.pair_verdicts(judgments(t), ["judge", "comparison", "rep", "len1", "len2", "feat1", "feat2"])
    return rounded(L.preference_drivers(v, ["judge", "comparison"]))


@query("e34_judge_pilot", f"""{PREF}, g AS (SELECT judge, count(verdict) / count(*)::DOUBLE AS p, count(*) FILTER (verdict IN ('S1', 'S2')) / count(*)::DOUBLE AS d FROM vd GROUP BY 1),
  e AS (SELECT *, p >= 0.9 AND d >= 0.5 AS eligible FROM g), b AS (SELECT judge AS best FROM e WHERE eligible ORDER BY d DESC, judge LIMIT 1)
  SELECT judge, round(p, 6) AS parse_rate, round(d, 6) AS decisive_rate, eligible, coalesce(judge = best, false) AS selected FROM e LEFT JOIN b ON true""")
def e34_judge_pilot(t):
    return rounded(L.judge_pilot(judgments(t), ["rep"], 0.9, 0.5))


def _e43() -> str:
    lo, hi = K.ci("a.v / nullif(a.n, 0) - r.v / nullif(r.n, 0)", "fixed", 5000)
    return f"""{PREF}, ad AS MATERIALIZED (SELECT comparison AS arm, (verdict = 'S1')::INT AS v FROM vd WHERE judge = 'matches' AND verdict IN ('S1', 'S2')),
  {K.boot('bo', 'ad', ['arm'], ['v'], draws=5000)}, ci AS (SELECT a.arm, {lo} AS lo, {hi} AS hi FROM bo a JOIN bo r ON r.draw = a.draw AND r.arm = 'C0' WHERE a.arm <> 'C0' GROUP BY 1),
  po AS (SELECT arm, count(*) AS n, avg(v) AS share FROM ad GROUP BY 1)
  SELECT p.arm, p.n, round(p.share, 6) AS share, round(z.share, 6) AS share0, round(CASE WHEN p.n >= 6 AND z.n >= 6 THEN lo END, 6) AS shift_lo,
   round(CASE WHEN p.n >= 6 AND z.n >= 6 THEN hi END, 6) AS shift_hi, CASE WHEN NOT (p.n >= 6 AND z.n >= 6) OR lo IS NULL THEN 'not evaluable' WHEN hi < 0 THEN 'down' WHEN lo > 0 THEN 'up' ELSE 'none' END AS moved
  FROM po p JOIN ci USING (arm) CROSS JOIN (SELECT * FROM po WHERE arm = 'C0') z"""


@query("e43_directive_shift", _e43())
def e43_directive_shift(t):
    v = L.pair_verdicts(judgments(t).where("judge = 'matches'"), ["comparison", "rep"])
    a = v.select(F.col("comparison").alias("arm"), F.when(F.col("verdict") == "S1", 1).when(F.col("verdict") == "S2", 0).alias("v"))
    return rounded(L.directive_shift(a, "arm", "C0", "v"))


def fate_labels(t):
    """Two judges name each sentence's fate by length or by matches; one reply in nineteen is lost."""
    s = t.sentences.select("doc_id", "pos", F.length("s").alias("n"), F.bit_count(X.families_mask("s", LEX)).alias("k"))
    one = F.when(F.col("n") > 90, "RESOLVED").when(F.col("n") > 40, "ACKNOWLEDGED").otherwise("DROPPED")
    two = F.when((F.col("doc_id") + F.col("pos")) % 19 != 0,
                 F.when(F.col("k") >= 1, "RESOLVED").when(F.col("n") > 40, "ACKNOWLEDGED").otherwise("DROPPED"))
    each = F.explode(F.array(F.struct(F.lit("one").alias("judge"), one.alias("fate")), F.struct(F.lit("two").alias("judge"), two.alias("fate"))))
    return s.select("doc_id", "pos", each.alias("e")).select("doc_id", "pos", "e.*")


_FATE = f"""{SENT}, ft AS MATERIALIZED (SELECT doc_id, pos, CASE WHEN n > 90 THEN 'RESOLVED' WHEN n > 40 THEN 'ACKNOWLEDGED' ELSE 'DROPPED' END AS a,
   CASE WHEN (doc_id + pos) % 19 <> 0 THEN CASE WHEN k >= 1 THEN 'RESOLVED' WHEN n > 40 THEN 'ACKNOWLEDGED' ELSE 'DROPPED' END END AS b
   FROM (SELECT doc_id, pos, length(s) AS n, bit_count({K.mask('t', LEX)}) AS k FROM se))"""
_flo, _fhi = K.wilson("o", "ag")


@query("e44_fate_by_position", f"""{_FATE}, g AS (SELECT least(pos, 4)::INT AS position, a AS fate, count(*) AS n FROM ft WHERE a = b GROUP BY 1, 2)
  SELECT position, fate, n, sum(n) OVER (PARTITION BY position)::BIGINT AS agreed, round(n / sum(n) OVER (PARTITION BY position)::DOUBLE, 6) AS share FROM g""")
def e44_fate_by_position(t):
    return rounded(L.fate(fate_labels(t), ["doc_id"], "one", "two", "pos"))


@query("e44_fate_summary", f"""{_FATE}, g AS (SELECT count(*) AS judged, count(*) FILTER (b IS NULL) AS quarantined, count(*) FILTER (a <> b) AS disagree,
   count(*) FILTER (a = b) AS ag, count(*) FILTER (a = b AND a <> 'RESOLVED') AS o FROM ft)
  SELECT judged, quarantined, disagree, ag AS agreed, o AS open, round(o / ag::DOUBLE, 6) AS headroom, round({_flo}, 6) AS headroom_lo, round({_fhi}, 6) AS headroom_hi, 'evaluable' AS status FROM g""")
def e44_fate_summary(t):
    return rounded(L.fate_summary(fate_labels(t), ["doc_id", "pos"], "one", "two"))


def _e42() -> str:
    lo, hi = K.ci("na / nullif(da, 0) - nb / nullif(db, 0)", "truncate", 5000)
    rlo, rhi = K.wilson("routed", "flags")
    return f"""WITH r AS MATERIALIZED (SELECT doc_id % 50 AS item, CASE WHEN lang = 'en' THEN 'in' ELSE 'out' END AS cond, source AS home,
     CASE WHEN contains(text, 'tion') THEN CASE WHEN doc_id % 3 = 0 THEN source ELSE 'src1' END END AS flag FROM documents),
  un AS MATERIALIZED (SELECT 1 AS g, item, sum(CASE WHEN cond = 'out' THEN (flag IS NOT NULL)::INT ELSE 0 END)::DOUBLE AS na, (count(*) FILTER (cond = 'out'))::DOUBLE AS da,
     sum(CASE WHEN cond = 'in' THEN (flag IS NOT NULL)::INT ELSE 0 END)::DOUBLE AS nb, (count(*) FILTER (cond = 'in'))::DOUBLE AS db FROM r GROUP BY 1, 2),
  {K.boot('bo', 'un', ['g'], ['na', 'da', 'nb', 'db'], key=['item'], draws=5000)}, ci AS (SELECT {lo} AS lo, {hi} AS hi FROM bo),
  po AS (SELECT sum(na) / sum(da) AS ra, sum(nb) / sum(db) AS rb FROM un),
  rt AS (SELECT count(*) AS flags, count(*) FILTER (flag = home) AS routed FROM r WHERE cond = 'out' AND flag IS NOT NULL)
  SELECT round(ra, 6) AS out_rate, round(rb, 6) AS in_rate, round(lo, 6) AS diff_lo, round(hi, 6) AS diff_hi,
   CASE WHEN lo IS NULL THEN 'not evaluable' WHEN lo > 0 THEN 'discriminates' WHEN ra >= 0.8 AND rb >= 0.8 THEN 'ceiling' WHEN ra <= 0.2 AND rb <= 0.2 THEN 'floor' ELSE 'no gap' END AS verdict,
   flags, routed, round(routed / nullif(flags, 0)::DOUBLE, 6) AS routing, round({rlo}, 6) AS routing_lo, round({rhi}, 6) AS routing_hi FROM po CROSS JOIN ci CROSS JOIN rt"""


@query("e42_flag_gap", _e42())
def e42_flag_gap(t):
    flag = F.when(F.contains("text", F.lit("tion")), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("src1"))
    r = t.documents.select((F.col("doc_id") % 50).alias("item"), F.when(F.col("lang") == "en", "in").otherwise("out").alias("cond"),
                           F.col("source").alias("home"), flag.alias("flag"))
    return rounded(L.flag_gap(r, "item"))


_GR = f"""WITH gr AS MATERIALIZED (SELECT doc_id, CASE WHEN lang = 'en' THEN 'POS' WHEN lang = 'de' THEN 'NEG' ELSE 'OVER' END AS pool, CASE WHEN doc_id % 13 <> 0 THEN least(k, 3) END AS a,
   CASE WHEN doc_id % 11 <> 0 THEN least(k + doc_id % 2, 3) END AS b FROM (SELECT *, bit_count({K.mask(K.ascii_text('text'), LEX)})::INT AS k FROM documents)),
  pp AS (SELECT pool, count(*) AS n, count(*) FILTER (a IS NULL OR b IS NULL) AS quarantined, avg((a + b) / 2.0) AS mean_grade,
     count(*) FILTER ((a >= 2) = (b >= 2)) / nullif(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), 0)::DOUBLE AS agreement FROM gr GROUP BY 1),
  oa AS (SELECT count(*) FILTER ((a >= 2) = (b >= 2)) / count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)::DOUBLE AS pooled_agreement FROM gr),
  ys AS (SELECT 1 AS one, (pool = 'POS')::INT AS y, (a + b) / 2.0 AS score FROM gr WHERE pool IN ('POS', 'NEG') AND a IS NOT NULL AND b IS NOT NULL), {_auc_sql('one', 'ys')}"""


@query("e55_validate_matcher", f"""{_GR} SELECT pool, n, quarantined, round(mean_grade, 6) AS mean_grade, round(agreement, 6) AS agreement, round(pooled_agreement, 6) AS pooled_agreement,
   round(auc, 6) AS auc, CASE WHEN auc >= 0.8 AND pooled_agreement >= 0.7 THEN 'pass' ELSE 'fail' END AS gate FROM pp CROSS JOIN oa CROSS JOIN au""")
def e55_validate_matcher(t):
    k = F.bit_count(X.families_mask("text", LEX))
    d = t.documents.select("doc_id", F.when(F.col("lang") == "en", "POS").when(F.col("lang") == "de", "NEG").otherwise("OVER").alias("pool"), k.alias("k"))
    rows = F.explode(F.array(
        F.struct(F.lit("one").alias("judge"), F.when(F.col("doc_id") % 13 != 0, F.least("k", F.lit(3))).otherwise(-1).alias("grade")),
        F.struct(F.lit("two").alias("judge"), F.when(F.col("doc_id") % 11 != 0, F.least(F.col("k") + F.col("doc_id") % 2, F.lit(3)).cast("int")).otherwise(-1).alias("grade"))))
    g = d.select("doc_id", "pool", rows.alias("e")).select("doc_id", "pool", "e.*")
    return rounded(L.validate_matcher(g, ["doc_id"], "one", "two"))
