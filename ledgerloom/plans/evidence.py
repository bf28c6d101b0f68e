"""Queries on evidence of inventions, detectors side by side, gates of judges, doses and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.lexicons import lexicon
from ledgerloom.operators import evidence as E
from ledgerloom.operators import labels as L
from ledgerloom.operators import pairs as D
from ledgerloom.operators import ranks as R
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded
from ledgerloom.plans.labels import _FATE, _SCORE, fate_labels, scored_labels
from ledgerloom.plans.provenance import _ATT, LEX, _attempts

FAMS = lexicon(LEX)
BASE = f"WITH {K.DEALT}, {K.audited(LEX)}"
SAID = {f: f"{f} language" for f in list(FAMS)[:2]}
BIT = {f: 1 << i for i, f in enumerate(FAMS)}


def ascii_only(c):
    """As the oracles see text."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "z")


def _found(fam: str, limit: int = 5) -> str:
    return "(" + " || ".join(f"regexp_extract_all(t, {K.q(p)}, 0, 'i')" for p in FAMS[fam]) + f")[1:{limit}]"


# ---------------------------------------------------------------- manifest and gate

_each = " UNION ALL ".join(
    f"SELECT run_id, '{f}' AS family, {_found(f)} AS ph, ss FROM o WHERE (invented & {BIT[f]}) <> 0" for f in FAMS)


@query("v3_manifest_flagged", f"""{BASE}, o AS (SELECT r.run_id, invented, {K.ascii_text('output')} AS t,
    list_transform({K.sents_len('output', 31, None)}, lambda s: {K.ascii_text('s')}) AS ss FROM runs r JOIN aud a ON a.run_id = r.run_id WHERE invented <> 0),
  e AS ({_each})
  SELECT run_id, family, array_to_string(ph[1:4], '|') AS phrases,
    coalesce(substr(list_filter(ss, lambda s: len(list_filter(ph, lambda p: contains(lower(s), lower(p)))) > 0)[1], 1, 400), '') AS excerpt FROM e""")
def v3_manifest_flagged(t):
    """Invented families of every run: four phrases and the first sentence that holds one."""
    m = E.flagged(t.runs, LEX)
    return m.select("run_id", "family", ascii_only(F.array_join("phrases", "|")).alias("phrases"), ascii_only("excerpt").alias("excerpt"))


_lines = ", ".join(
    f"CASE WHEN (invented & {BIT[f]}) <> 0 THEN chr(10) || '- {SAID.get(f, f)}: ' || array_to_string("
    f"list_transform({_found(f, 3)}, lambda p: chr(34) || p || chr(34)), ', ') END" for f in sorted(FAMS))


@query("v4_feedback_sent", f"""{_ATT}, w AS (SELECT *, min(CASE WHEN invented = 0 THEN attempt END) OVER (PARTITION BY run_id) AS ok,
    max(attempt) OVER (PARTITION BY run_id) AS la FROM aa),
  x AS (SELECT w.run_id, w.attempt, invented, {K.ascii_text('o')} AS t FROM w JOIN att ON att.run_id = w.run_id AND att.attempt = w.attempt
    WHERE invented <> 0 AND w.attempt < la AND (ok IS NULL OR w.attempt < ok))
  SELECT run_id, attempt, {K.q(E.FEEDBACK_HEAD)} || concat({_lines}) || chr(10) || {K.q(E.FEEDBACK_TAIL)} AS feedback FROM x""")
def v4_feedback_sent(t):
    """Requests to revise between the stored attempts of every run."""
    f = E.feedback_sent(_attempts(t), LEX, floor=100, described=SAID)
    return f.withColumn("feedback", ascii_only("feedback"))


_names = ", ".join(f"CASE WHEN (invented & {BIT[f]}) <> 0 THEN '{SAID.get(f, f)}' END" for f in sorted(FAMS))


@query("v4_annotation", f"""{BASE} SELECT run_id,
  CASE WHEN invented <> 0 THEN {K.q(E.ANNOTATION_HEAD)} || concat_ws(', ', {_names}) || {K.q(E.ANNOTATION_TAIL)} END AS note FROM aud""")
def v4_annotation(t):
    return t.audited().select("run_id", E.annotation("invented_mask", LEX, SAID).alias("note"))


# ---------------------------------------------------------------- two detectors

_TWO = f"""WITH {K.DEALT}, tw AS MATERIALIZED (SELECT length(output) AS chars, {K.mask('u', 'prose')} AS ra, {K.mask('o', 'prose')} AS pa,
    {K.mask('u', 'prose_loose')} AS rb, {K.mask('o', 'prose_loose')} AS pb
  FROM (SELECT output, {K.ascii_text('up')} AS u, {K.ascii_text('output')} AS o FROM runs)),
  iv AS (SELECT ra, rb, CASE WHEN chars < 500 THEN 0 ELSE {K.minus('pa', 'ra')} END AS ia, CASE WHEN chars < 500 THEN 0 ELSE {K.minus('pb', 'rb')} END AS ib FROM tw)"""


@query("v20_run_divergence", f"""{_TWO} SELECT count(*) AS runs, count(*) FILTER (ia <> 0 AND ib <> 0) AS both, count(*) FILTER (ia <> 0 AND ib = 0) AS only_a,
  count(*) FILTER (ia = 0 AND ib <> 0) AS only_b, count(*) FILTER (ia = 0 AND ib = 0) AS neither, count(*) FILTER ((ia & ib) <> 0) AS same_family,
  round(count(*) FILTER ((ia <> 0) <> (ib <> 0)) / count(*)::DOUBLE, 6) AS divergence FROM iv""")
def v20_run_divergence(t):
    return rounded(E.run_divergence(t.runs, "prose", "prose_loose"))


@query("v20_supply_histograms", f"""{_TWO}, l AS (SELECT bit_count(ra)::INT AS supply, 1 AS a, 0 AS b FROM iv UNION ALL SELECT bit_count(rb)::INT, 0, 1 FROM iv)
  SELECT supply, sum(a)::BIGINT AS runs_a, sum(b)::BIGINT AS runs_b FROM l GROUP BY 1""")
def v20_supply_histograms(t):
    return E.supply_histograms(t.runs, "prose", "prose_loose")


# ---------------------------------------------------------------- judges

_over = "count(*) FILTER (quality = {y} AND score >= i / 100.0::DOUBLE) / nullif(count(*) FILTER (quality = {y}), 0)::DOUBLE"


@query("e27_youden_grid", f"""WITH {_SCORE}, g AS (SELECT lang, i / 100.0::DOUBLE AS c, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg,
    round({_over.format(y=1)} - {_over.format(y=0)}, 12) AS j FROM sc CROSS JOIN (SELECT unnest(range(5, 100, 5)) AS i) GROUP BY lang, i),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY j DESC, c) AS rn FROM g)
  SELECT lang, n_pos, n_neg, CASE WHEN n_pos >= 5 AND n_neg >= 5 THEN round(c, 6) END AS cut, CASE WHEN n_pos >= 5 AND n_neg >= 5 THEN round(j, 6) END AS j FROM r WHERE rn = 1""")
def e27_youden_grid(t):
    return rounded(R.youden_grid(scored_labels(t), ["lang"], "quality", "score"))


# Two judges that read labelled documents in batches of 1, 5 and 25: the larger the batch, the more replies are unusable.
_ASK = f"""WITH {_SCORE}, rp AS MATERIALIZED (SELECT size, doc_id AS unit, judge, doc_id // size AS batch, (doc_id // size * 31 + size * k) % 97 >= size AS parsed, family,
     CASE WHEN family = 'quality' THEN CASE judge WHEN 'length' THEN n_chars >= 400 ELSE score < 0.9 END
       ELSE CASE judge WHEN 'length' THEN n_chars < 10 ELSE score < 0 END END AS says,
     CASE WHEN family = 'quality' THEN quality = 1 ELSE toxic = 1 END AS truth, doc_id % 4 = 0 AS anchor
   FROM sc CROSS JOIN (SELECT unnest([1, 5, 25]) AS size) CROSS JOIN (VALUES ('length', 3), ('density', 7)) j(judge, k) CROSS JOIN (VALUES ('quality'), ('toxic')) f(family)),
  lb AS (SELECT *, CASE WHEN parsed THEN says END AS value FROM rp),
  ab AS (SELECT size, unit, family, any_value(truth) AS truth, bool_or(CASE WHEN judge = 'length' THEN value END) AS x,
     bool_or(CASE WHEN judge = 'density' THEN value END) AS y FROM lb WHERE NOT anchor GROUP BY 1, 2, 3),
  gt AS (SELECT size, 'parse' AS gate, judge AS subject, count(*) AS n, count(*) FILTER (NOT parsed) AS hits, 0.2::DOUBLE AS bar
      FROM (SELECT DISTINCT size, judge, batch, parsed FROM rp) GROUP BY 1, 2, 3
    UNION ALL SELECT size, 'consistency', family, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL),
      count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND (x AND y) = truth), 0.8 FROM ab GROUP BY 1, 2, 3
    UNION ALL SELECT size, 'anchor', judge, count(value), count(*) FILTER (value = truth), 0.8 FROM lb WHERE anchor GROUP BY 1, 2, 3),
  gk AS (SELECT *, hits / n::DOUBLE AS rate, coalesce(CASE WHEN gate = 'parse' THEN hits / n::DOUBLE < bar ELSE hits / n::DOUBLE >= bar END, false) AS ok FROM gt)"""


def _batch_gates(t):
    s = scored_labels(t)
    judged = s.select("doc_id", "n_chars", "score", F.explode(F.array(*[F.lit(n) for n in (1, 5, 25)])).alias("size"))
    judged = judged.select("*", F.floor(F.col("doc_id") / F.col("size")).alias("batch"), F.explode(F.array(*[
        F.struct(F.lit(j).alias("judge"), F.lit(k).alias("k")) for j, k in (("length", 3), ("density", 7))])).alias("j"))
    judged = judged.withColumn("parsed", (F.col("batch") * 31 + F.col("size") * F.col("j.k")) % 97 >= F.col("size"))
    long = F.col("j.judge") == "length"
    says = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.when(F.col("parsed"), v).alias("value")) for f, v in (
        ("quality", F.when(long, F.col("n_chars") >= 400).otherwise(F.col("score") < 0.9)),
        ("toxic", F.when(long, F.col("n_chars") < 10).otherwise(F.col("score") < 0)))]))
    labels = judged.select("size", F.col("doc_id").alias("unit"), "j.judge", says.alias("e")).select("size", "unit", "judge", "e.*")
    known = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), (F.col(f) == 1).alias("truth")) for f in ("quality", "toxic")]))
    truth = t.read("labels").select(F.col("doc_id").alias("unit"), (F.col("doc_id") % 4 == 0).alias("anchor"), known.alias("e")).select("unit", "anchor", "e.*")
    batches = judged.select("size", "j.judge", "batch", "parsed").distinct()
    return L.batch_gates(labels, truth, batches, "length", "density", ["quality", "toxic"])


@query("e29_batch_gates", f"{_ASK} SELECT size, gate, subject, n, hits, round(rate, 6) AS rate, ok FROM gk")
def e29_batch_gates(t):
    """Parse failures, consistency with frozen labels and anchors, per batch size."""
    return rounded(_batch_gates(t))


@query("e29_batch_verdict", f"""{_ASK}, v AS (SELECT size, count(*) AS gates, count(*) FILTER (NOT ok) AS failed FROM gk GROUP BY 1)
  SELECT size, gates, failed, failed = 0 AS passes, coalesce(size = (SELECT max(size) FROM v WHERE failed = 0), false) AS shipped FROM v""")
def e29_batch_verdict(t):
    return L.batch_verdict(_batch_gates(t))


_mlo, _mhi = K.wilson("n", "u")


@query("e44_fate_marginals", f"""{_FATE}, l AS (SELECT 'one' AS rater, a AS fate FROM ft UNION ALL SELECT 'two', b FROM ft UNION ALL SELECT 'agreed', CASE WHEN a = b THEN a END FROM ft),
  g AS (SELECT rater, fate, count(*) AS n, (sum(count(*)) OVER (PARTITION BY rater))::BIGINT AS u FROM l WHERE fate IS NOT NULL GROUP BY 1, 2)
  SELECT rater, fate, n, u AS usable, round(n / u::DOUBLE, 6) AS share, round({_mlo}, 6) AS share_lo, round({_mhi}, 6) AS share_hi FROM g""")
def e44_fate_marginals(t):
    return rounded(L.fate_marginals(fate_labels(t), ["doc_id", "pos"], "one", "two"))


# ---------------------------------------------------------------- doses and requests

@query("d15_dose_match", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS r FROM documents),
  k AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) SELECT doc_id, lang FROM r, k WHERE r <= k""")
def d15_dose_match(t):
    """Documents of every language in the dose of the rarest."""
    return D.dose_match(t.read("documents").select("doc_id", "lang"), "lang", "doc_id")


_HEAD = [K.q(h).replace("\n", "' || chr(10) || '") for h in D.PAIR_HEADS]


@query("d21_pair_requests", f"""WITH {K.DEALT}, w AS (SELECT run_id, coalesce(output, '') AS q, coalesce(alpha, '') AS x, coalesce(beta, '') AS y, judge, ordering
    FROM runs CROSS JOIN (VALUES ('one'), ('two')) j(judge) CROSS JOIN (VALUES ('fwd'), ('rev')) o(ordering)
    WHERE NOT (judge = 'one' AND ordering = 'rev' AND run_id IN (SELECT doc_id FROM labels WHERE quality = 1)))
  SELECT run_id, judge, ordering, md5({_HEAD[0]} || q || {_HEAD[1]} || CASE ordering WHEN 'fwd' THEN x ELSE y END || {_HEAD[2]} || CASE ordering WHEN 'fwd' THEN y ELSE x END) AS body FROM w""")
def d21_pair_requests(t):
    """Two seats of every run before two judges in both orderings, without the verdicts there are (label 0 is a failed call)."""
    pairs = t.dealt.select("run_id", F.col("output").alias("question"), F.col("alpha").alias("first"), F.col("beta").alias("second"))
    done = t.read("labels").select(F.col("doc_id").alias("run_id"), F.lit("one").alias("judge"), F.lit("rev").alias("ordering"),
                                   F.when(F.col("quality") == 1, "A").alias("verdict"))
    return D.pair_requests(pairs, "run_id", ["one", "two"], done).withColumn("body", F.md5("body"))


PROPERTIES = {"hedge": "says how sure it is", "limit": "names a limit", "cause": "gives a reason", "order": "tells what comes first"}
_PV = ", ".join(f"('{k}', '- {k}: {v}')" for k, v in PROPERTIES.items())


@query("d21_property_requests", f"""WITH w AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
  x AS (SELECT doc_id, p, line, md5('42|' || doc_id || '|' || p) AS h FROM w CROSS JOIN (VALUES {_PV}) v(p, line))
  SELECT doc_id, string_agg(p, ',' ORDER BY h) AS properties, string_agg(line, chr(10) ORDER BY h) AS definitions FROM x GROUP BY 1""")
def d21_property_requests(t):
    """Documents without a result, the properties asked for in an order of each document's own."""
    done = t.read("labels").select("doc_id", F.when(F.col("toxic") == 1, True).alias("result"))
    r = D.property_requests(t.read("documents").select("doc_id"), "doc_id", PROPERTIES, done)
    return r.withColumn("properties", F.array_join("properties", ","))
