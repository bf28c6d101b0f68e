"""Dictation and probe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import dictation as D
from ledgerloom.operators import probes as B
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded
from ledgerloom.plans.labels import SENT

LEX = "prose"
REG = f"""rg AS MATERIALIZED (SELECT item_id * 1000 + i AS id, trim(p) AS phrase FROM (SELECT item_id, unnest(ss) AS p, generate_subscripts(ss, 1) - 1 AS i FROM (
   SELECT item_id, {K.sents('text')} AS ss FROM benchmark)))"""


def registry(t):
    """Benchmark sentences as the registry of dictated phrases."""
    b = X.explode_rows(t.read("benchmark"), ["item_id"], X.sentences("text"), "i", "p")
    return b.select((F.col("item_id") * 1000 + F.col("i")).alias("id"), F.trim("p").alias("phrase"))


@query("v11_literal_hits", f"""{SENT}, {REG} SELECT doc_id, pos::INT AS pos, id FROM se JOIN rg ON length(phrase) >= 8 AND contains(lower(s), lower(phrase))""")
def v11_literal_hits(t):
    """Benchmark sentences contained in document sentences, exactly and without pairing everything."""
    return D.literal_hits(t.sentences, ["doc_id", "pos"], "s", registry(t))


@query("v11_literal_hits_joined", f"""WITH {REG} SELECT doc_id, id FROM documents JOIN rg ON length(phrase) >= 8 AND contains(lower(text), lower(phrase))""")
def v11_literal_hits_joined(t):
    """The same containment in whole documents."""
    return D.literal_hits(t.documents, ["doc_id"], "text", registry(t))


@query("v11_dictation_gate", f"""WITH {REG} SELECT conv_id, turn, id FROM conversations JOIN rg ON contains(lower(text), lower(phrase))""")
def v11_dictation_gate(t):
    """Conversation turns that restate registry phrases."""
    return D.literal_hits(t.conversations, ["conv_id", "turn"], "text", registry(t), min_len=1)


_TOK = ("list_distinct(list_transform(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: length(w) > 3), "
        "lambda w: lower(regexp_replace(w, '^[.,;:()\\[\\]\"'']+|[.,;:()\\[\\]\"'']+$', '', 'g'))))")


_V12 = f"""WITH {REG}, rt AS (SELECT id, unnest({_TOK.format('phrase')}) AS tok FROM rg),
  st AS (SELECT conv_id, turn, unnest({_TOK.format('text')}) AS tok FROM conversations),
  ov AS (SELECT conv_id, turn, id, count(*) AS overlap FROM st JOIN rt USING (tok) GROUP BY 1, 2, 3),
  al AS (SELECT conv_id, turn, id, overlap FROM ov UNION ALL SELECT c.conv_id, c.turn, r.id, 0 FROM conversations c CROSS JOIN (SELECT id FROM rg) r
     WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.conv_id = c.conv_id AND ov.turn = c.turn AND ov.id = r.id)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, id) AS rank FROM al)
  SELECT conv_id, turn, rank::INT AS rank, id, overlap::INT AS overlap FROM rk WHERE rank <= 8"""


@query("v12_shortlist", _V12)
def v12_shortlist(t):
    return D.shortlist(t.conversations, ["conv_id", "turn"], "text", registry(t))


@query("v12_shortlist_hot", _V12)
def v12_shortlist_hot(t):
    """The same where every token in more than three phrases counts as hot."""
    return D.shortlist(t.conversations, ["conv_id", "turn"], "text", registry(t), hot=3)


_POOL = f"""{SENT}, {REG}, hit AS (SELECT DISTINCT doc_id, pos FROM se JOIN rg ON length(phrase) >= 8 AND contains(lower(s), lower(phrase))),
  fl AS (SELECT se.doc_id, se.pos, regexp_matches(source, '^src1?[02468]$') AS dictated, h.doc_id IS NOT NULL AS literal, {K.mask('t', LEX)} <> 0 AS construct
     FROM se LEFT JOIN hit h ON h.doc_id = se.doc_id AND h.pos = se.pos),
  pl AS (SELECT *, CASE WHEN dictated AND literal THEN 'POS' WHEN NOT dictated AND literal THEN 'OVER' WHEN NOT dictated AND construct THEN 'NEG' END AS pool FROM fl),
  kp AS MATERIALIZED (SELECT * FROM pl WHERE pool IS NOT NULL)"""


def _pools(t):
    s = t.sentences
    hits = D.literal_hits(s, ["doc_id", "pos"], "s", registry(t)).select("doc_id", "pos").distinct().withColumn("literal", F.lit(True))
    f = s.select("doc_id", "pos", F.col("source").rlike("^src1?[02468]$").alias("dictated"), (X.families_mask("s", LEX) != 0).alias("construct"))
    f = f.join(hits, ["doc_id", "pos"], "left").withColumn("literal", F.coalesce("literal", F.lit(False)))
    return D.pools(f, ["doc_id", "pos"])


@query("v13_dictation_pools", f"{_POOL} SELECT doc_id, pos::INT AS pos, pool FROM kp")
def v13_dictation_pools(t):
    return _pools(t).select("doc_id", "pos", "pool")


@query("v13_pool_counts", f"""{_POOL} SELECT pool, count(doc_id) AS available, count(doc_id) >= 30 AS enough
  FROM (SELECT unnest(['POS', 'OVER', 'NEG']) AS pool) LEFT JOIN kp USING (pool) GROUP BY pool""")
def v13_pool_counts(t):
    return D.pool_counts(_pools(t))


_olo, _ohi = K.wilson("k", "n")


@query("v13_over_attribution", f"""{_POOL}, g AS (SELECT count(*) AS n, count(*) FILTER (construct) AS k FROM kp WHERE pool = 'OVER')
  SELECT n, k, round(k / nullif(n, 0)::DOUBLE, 6) AS rate, round({_olo}, 6) AS lo, round({_ohi}, 6) AS hi FROM g""")
def v13_over_attribution(t):
    return rounded(D.over_attribution(_pools(t), "construct"))


W = f"WITH {K.DEALT}"
_w = lambda e: f"regexp_extract({e}, '[a-z]{{6,}}', 0)"


def _probed(t):
    """Runs with the first long word of two seats as the planted right and wrong values."""
    word = lambda c: F.filter(F.array(F.regexp_extract(c, "[a-z]{6,}", 0)), lambda p: p != "")
    return t.dealt.select("run_id", "prompt_id", "condition", F.col("writer_id").alias("arm"), "output", word("alpha").alias("right"), word("beta").alias("wrong"))


_PR = f"""{W}, pb AS MATERIALIZED (SELECT run_id, writer_id AS arm, {_w('alpha')} <> '' AND contains(lower(output), {_w('alpha')}) AS r, {_w('beta')} <> '' AND contains(lower(output), {_w('beta')}) AS w FROM runs)"""
_DEC = "round(count(*) FILTER (r AND NOT w) / nullif(count(*) FILTER (r <> w), 0)::DOUBLE, 6) AS decisive_share"


@query("v14_adoption_three_way", f"{_PR} SELECT arm, count(*) AS n, count(*) FILTER (r AND NOT w) AS correct, count(*) FILTER (w) AS corrupted, count(*) FILTER (NOT r AND NOT w) AS neither, {_DEC} FROM pb GROUP BY 1")
def v14_adoption_three_way(t):
    return rounded(B.adoption(_probed(t), "right", "wrong", "arm"))


@query("v14_adoption_four_way", f"{_PR} SELECT arm, count(*) AS n, count(*) FILTER (r AND NOT w) AS clean, count(*) FILTER (w AND NOT r) AS wrong, count(*) FILTER (r AND w) AS both, count(*) FILTER (NOT r AND NOT w) AS neither, {_DEC} FROM pb GROUP BY 1")
def v14_adoption_four_way(t):
    return rounded(B.adoption(_probed(t), "right", "wrong", "arm", split="four_way"))


_plo, _phi = K.wilson("propagated", "judged")


@query("v15_propagation", f"""{_PR}, j AS (SELECT p.run_id, CASE WHEN run_id % 3 = 0 THEN 'control' ELSE 'inject' END AS arm, CASE WHEN run_id % 2 = 0 THEN 'figure' ELSE 'term' END AS kind, run_id % 3 AS ix, r AS exact,
    CASE WHEN run_id % 11 <> 0 THEN r END AS a1, CASE WHEN run_id % 7 <> 0 THEN r OR w END AS a2, CASE WHEN run_id % 5 <> 0 THEN run_id % 3 END AS s1, CASE WHEN run_id % 2 = 0 THEN run_id % 3 ELSE 1 END AS s2 FROM pb p),
  f AS (SELECT *, a1 IS NOT NULL AND a2 IS NOT NULL AS jd, coalesce(a1 AND a2, false) AS pp FROM j),
  g AS (SELECT arm, kind, count(*) AS runs, count(*) FILTER (jd) AS judged, count(*) FILTER (pp) AS propagated, count(*) FILTER (exact) AS exact,
    count(*) FILTER (pp AND s1 IS NOT NULL) AS attributable, count(*) FILTER (pp AND s1 = s2 AND s1 = ix) AS attributed FROM f GROUP BY 1, 2)
  SELECT *, round(propagated / nullif(judged, 0)::DOUBLE, 6) AS rate, round({_plo}, 6) AS rate_lo, round({_phi}, 6) AS rate_hi,
   round(CASE WHEN attributable >= 10 THEN attributed / attributable::DOUBLE END, 6) AS attribution FROM g""")
def v15_propagation(t):
    """Planted claims: two judges' assertions and attributions against the literal lower bound."""
    p = _probed(t)
    o = X.norm("output", "money")
    f = p.select("run_id", B.contains_any(o, "right", "money").alias("r"), B.contains_any(o, "wrong", "money").alias("w"))
    k = F.col("run_id")
    inj = f.select("run_id", F.when(k % 3 == 0, "control").otherwise("inject").alias("arm"), F.when(k % 2 == 0, "figure").otherwise("term").alias("kind"),
                   (k % 3).alias("injected_index"), F.col("r").alias("exact"))
    rows = F.explode(F.array(
        F.struct(F.lit("one").alias("judge"), F.when(k % 11 != 0, F.col("r")).alias("asserts"), F.when(k % 5 != 0, k % 3).alias("specialist")),
        F.struct(F.lit("two").alias("judge"), F.when(k % 7 != 0, F.col("r") | F.col("w")).alias("asserts"), F.when(k % 2 == 0, k % 3).otherwise(F.lit(1)).alias("specialist"))))
    asserts = f.select("run_id", rows.alias("e")).select("run_id", "e.*")
    return rounded(B.propagation(asserts, "run_id", ["one", "two"], inj))


_alo, _ahi = K.wilson("correct", "n")


@query("v16_accuracy", f"""WITH a AS (SELECT source, lang, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'lot ' || n_chars ELSE 'lot none' END END AS line, text, n_chars FROM documents),
  s AS (SELECT lang, contains(lower(replace(replace(coalesce(line, text), ',', ''), '$', '')), n_chars::VARCHAR) AS c, line IS NOT NULL AS att FROM a),
  g AS (SELECT lang, count(*) AS n, count(*) FILTER (c) AS correct, count(*) FILTER (att) AS attempted, count(*) FILTER (c AND NOT att) AS fallback FROM s GROUP BY 1)
  SELECT *, round(correct / n::DOUBLE, 6) AS accuracy, round({_alo}, 6) AS lo, round({_ahi}, 6) AS hi FROM g""")
def v16_accuracy(t):
    """The accepted form is the document's own length, stated in an answer line on a part of the runs."""
    n = F.col("n_chars").cast("string")
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("lot $"), n)).otherwise(F.lit("lot none"))
    out = F.when(F.col("doc_id") % 4 != 0, F.concat("text", F.lit("\nANSWER: "), line)).otherwise(F.col("text"))
    return rounded(B.accuracy(t.documents.select("lang", out.alias("output"), F.array(n).alias("forms")), "forms", ["lang"]))


@query("v17_form_tracking", f"""{SENT}, x AS (SELECT doc_id, lang, lower(s) AS l, {K.mask('t', 'prose')} <> 0 AND {K.mask('t', 'prose_loose')} <> 0 AS c FROM se),
  g AS (SELECT doc_id, lang, bool_or(c) AS construct, bool_or(contains(l, 'with')) AS hx, bool_or(contains(l, 'tion')) AS hy, bool_or(c AND NOT contains(l, 'with')) AS nx, bool_or(c AND NOT contains(l, 'tion')) AS ny FROM x GROUP BY 1, 2)
  SELECT lang, count(*) AS runs, count(*) FILTER (construct) AS construct, count(*) FILTER (hx) AS has_x, count(*) FILTER (hy) AS has_y, count(*) FILTER (nx) AS without_x, count(*) FILTER (ny) AS without_y FROM g GROUP BY 1""")
def v17_form_tracking(t):
    s = t.sentences.select("doc_id", "lang", "s", ((X.families_mask("s", "prose") != 0) & (X.families_mask("s", "prose_loose") != 0)).alias("c"))
    f = B.form_tracking(s, "doc_id", "lang", "s", "c", {"x": "with", "y": "tion"})
    return f.groupBy("lang").agg(F.count("*").alias("runs"), *[F.count_if(F.col(c)).alias(c) for c in ("construct", "has_x", "has_y", "without_x", "without_y")])


@query("v18_tension_named", """SELECT source, count(*) AS n, count(*) FILTER (len(list_filter(string_split(lower(text), chr(10)), lambda l: contains(l, 'with') AND (contains(l, 'tion') OR contains(l, 'licen')))) > 0) AS named
  FROM documents GROUP BY 1""")
def v18_tension_named(t):
    hit = B.tension_named("text", F.lit("with"), F.array(F.lit("tion"), F.lit("licen")))
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(hit).alias("named"))


_sa = K.sents("alpha")
_fl = lambda e: f"lower(regexp_replace(replace({e}, '*', ''), '\\s+', ' ', 'g'))"
_st = "regexp_replace(s, '^\\s+|\\s+$', '', 'g')"


@query("v19_carriage", f"""{W}, cv AS (SELECT condition, run_id AS variant, list_filter({_sa}, lambda s: length(s) < 40) AS ss FROM runs),
  be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY len(ss) DESC, variant) AS r FROM cv) WHERE r = 1 AND len(ss) > 0),
  jn AS (SELECT condition, run_id, ss, {_fl('output')} AS b FROM runs JOIN be USING (condition)),
  ex AS (SELECT condition, run_id, b, {_fl(_st)} AS c FROM (SELECT condition, run_id, b, unnest(ss) AS s FROM jn))
  SELECT e.condition, count(DISTINCT run_id) AS runs, count(*) AS caveats, count(*) FILTER (contains(b, c)) AS carried_bare, count(*) AS carried_appendix,
   round(count(*) FILTER (contains(b, c)) / count(*)::DOUBLE, 6) AS share_bare, 1.0::DOUBLE AS share_appendix FROM ex e GROUP BY 1""")
def v19_carriage(t):
    """Short seat sentences as caveats: the richest variant per arm against every output of the arm."""
    c = t.dealt.select("condition", F.col("run_id").alias("variant"), F.filter(X.sentences("alpha"), lambda s: F.length(s) < 40).alias("sentences"))
    return rounded(B.carriage(t.dealt.select("condition", "output"), c, "condition"))
