"""Provenance and transport queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import provenance as V
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import masks_named, query, rounded

LEX = "prose"
FAMS = list(lexicon(LEX))
RUNS, AUD = K.DEALT, K.audited(LEX)
BASE = f"WITH {RUNS}, {AUD}"

CHAT = f"""WITH msg AS (SELECT conv_id, turn, role, length(text) AS chars, {K.mask('t', LEX)} AS m
  FROM (SELECT *, {K.ascii_text('text')} AS t FROM conversations)),
last AS (SELECT conv_id, max(turn) AS lt FROM msg WHERE role = 'assistant' GROUP BY 1),
chat AS (SELECT l.conv_id AS run_id,
   coalesce(bit_or(CASE WHEN m.role <> 'assistant' AND m.turn < l.lt THEN m.m END), 0) AS raised,
   max(CASE WHEN m.role = 'assistant' AND m.turn = l.lt THEN m.m END) AS present,
   max(CASE WHEN m.role = 'assistant' AND m.turn = l.lt THEN m.chars END) AS chars
  FROM last l JOIN msg m USING (conv_id) GROUP BY 1),
chat_s AS (SELECT *, CASE WHEN chars < 200 THEN 0 ELSE raised & present END AS kept,
   CASE WHEN chars < 200 THEN 0 ELSE {K.minus('present', 'raised')} END AS invented, chars < 200 AS floored FROM chat),
chat_a AS (SELECT *, bit_count(raised)::INT AS supply, bit_count(kept)::INT AS n_kept, bit_count(invented)::INT AS n_inv
  FROM chat_s)"""


@query("v1_audit_chat", f"""{CHAT} SELECT run_id, chars::BIGINT AS chars, {K.names('raised', LEX)} AS raised,
  {K.names('kept', LEX)} AS kept, {K.names('invented', LEX)} AS invented, supply, n_kept, n_inv AS n_invented, floored
FROM chat_a""")
def v1_audit_chat(t):
    """Chats as runs, audited in one grouped pass (floor 200)."""
    a = V.audit_chat(t.conversations, "assistant", LEX, floor=200)
    return masks_named(a, LEX, raised="raised_mask", kept="kept_mask", invented="invented_mask").select(
        "run_id", F.col("chars").cast("bigint").alias("chars"), "raised", "kept", "invented", "supply", "n_kept",
        "n_invented", F.col("floor_guard").alias("floored"))


@query("v2_dose_response_chat", f"""{CHAT} SELECT supply, count(*) AS n_runs, round(avg(n_kept), 6) AS mean_kept,
  round(avg(n_inv), 6) AS mean_invented, round(avg(n_kept + n_inv), 6) AS mean_emitted,
  round(avg(CASE WHEN n_kept + n_inv = 0 THEN 1.0 ELSE n_kept / (n_kept + n_inv)::DOUBLE END), 6) AS mean_traceability
FROM chat_a WHERE NOT floored GROUP BY supply""")
def v2_dose_response_chat(t):
    """The flagship slice: chat to run, audit, supply table."""
    return rounded(V.dose_response(V.audit_chat(t.conversations, "assistant", LEX, floor=200)))


@query("v1_audit", f"""{BASE} SELECT run_id, chars::BIGINT AS chars, {K.names('raised', LEX)} AS raised,
  {K.names('kept', LEX)} AS kept, {K.names('discarded', LEX)} AS discarded, {K.names('invented', LEX)} AS invented,
  supply::INT AS supply, emitted::INT AS emitted, round(traceability, 6) AS traceability, floored FROM aud""")
def v1_audit(t):
    a = masks_named(t.audited(), LEX, raised="raised_mask", kept="kept_mask", discarded="discarded_mask",
                    invented="invented_mask")
    return rounded(a.select(
        "run_id", F.col("chars").cast("bigint").alias("chars"), "raised", "kept", "discarded", "invented", "supply",
        "emitted", "traceability", F.col("floor_guard").alias("floored")))


def _evidence_sql() -> str:
    """Per family the first five matches in pattern order."""
    parts = []
    for i, (f, pats) in enumerate(lexicon(LEX).items()):
        hits = " || ".join(f"regexp_extract_all(oa, {K.q(p)}, 0, 'i')" for p in pats)
        parts.append(f"SELECT run_id, '{f}' AS family, array_to_string(({hits})[1:5], '|') AS evidence "
                     f"FROM e WHERE (invented & {1 << i}) <> 0")
    return " UNION ALL ".join(parts)


@query("v1_audit_evidence", f"""{BASE}, e AS (SELECT a.run_id, a.invented, {K.ascii_text('r.output')} AS oa
  FROM aud a JOIN runs r USING (run_id) WHERE a.invented <> 0) {_evidence_sql()}""")
def v1_audit_evidence(t):
    """Quoted evidence for every invented family (letters outside ASCII shown as z, for the oracle)."""
    a = V.audit(t.runs, LEX, evidence=True)
    each = a.select("run_id", F.explode_outer("evidence").alias("family", "m")).where(F.col("family").isNotNull())
    return each.select("run_id", "family", F.regexp_replace(
        F.array_join("m", "|"), r"[^\x00-\x7F]", "z").alias("evidence"))


@query("v1_audit_parts", f"""WITH {RUNS}, p AS (SELECT run_id, is_output, {K.mask('ta', LEX)} AS m, length(tt) AS c FROM (
    SELECT *, {K.ascii_text('tt')} AS ta FROM (
    SELECT run_id, true AS is_output, output AS tt FROM runs UNION ALL
    SELECT run_id, false, alpha FROM runs WHERE alpha <> '' UNION ALL
    SELECT run_id, false, beta FROM runs WHERE beta <> '' UNION ALL
    SELECT run_id, false, gamma FROM runs WHERE gamma <> ''))),
  g AS (SELECT run_id, coalesce(bit_or(CASE WHEN NOT is_output THEN m END), 0) AS raised,
    coalesce(bit_or(CASE WHEN is_output THEN m END), 0) AS present, sum(CASE WHEN is_output THEN c END) AS chars
    FROM p GROUP BY 1)
  SELECT run_id, bit_count(raised)::INT AS supply,
   (CASE WHEN chars < 500 THEN 0 ELSE bit_count(raised & present) END)::INT AS n_kept,
   (CASE WHEN chars < 500 THEN 0 ELSE bit_count({K.minus('present', 'raised')}) END)::INT AS n_invented FROM g""")
def v1_audit_parts(t):
    """The same audit over one row per part: bounded bit_or state, safe for runs of any size."""
    parts = t.dealt.select("run_id", F.lit(True).alias("is_output"), F.col("output").alias("text")).unionByName(
        t.seats.select("run_id", F.lit(False).alias("is_output"), "text"))
    return V.audit_parts(parts, LEX).select("run_id", "supply", "n_kept", "n_invented")


@query("v2_dose_response", f"""{BASE} SELECT condition, supply::INT AS supply, count(*) AS n_runs,
  round(avg(n_kept), 6) AS mean_kept, round(avg(n_inv), 6) AS mean_invented, round(avg(emitted), 6) AS mean_emitted,
  round(avg(traceability), 6) AS mean_traceability FROM aud WHERE NOT floored GROUP BY condition, supply""")
def v2_dose_response(t):
    return rounded(V.dose_response(t.audited(), ["condition"]))


@query("v2_dose_response_totals", f"""{BASE} SELECT condition, supply::INT AS supply, count(*) AS n_runs,
  round(avg(emitted), 6) AS mean_emitted FROM aud WHERE NOT floored
  GROUP BY GROUPING SETS ((condition, supply), (condition), ())""")
def v2_dose_response_totals(t):
    """Supply table with arm and grand totals from one rollup."""
    return rounded(t.audited().where(~F.col("floor_guard")).rollup("condition", "supply").agg(
        F.count("*").alias("n_runs"), F.avg("emitted").alias("mean_emitted")))


def _flags_sql(src: str = "aud", where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS family, ((raised & {1 << i}) <> 0)::INT AS r, ((present & {1 << i}) <> 0)::INT AS p, "
        f"(((raised & {1 << i}) <> 0) AND ((present & {1 << i}) <> 0))::INT AS rp FROM {src} WHERE {where}"
        for i, f in enumerate(FAMS))


def _v6() -> str:
    lo, hi = K.ci("rp / nullif(r, 0) - (p - rp) / nullif(n - r, 0)", "truncate")
    tlo, thi = K.wilson("kr", "nr")
    ilo, ihi = K.wilson("ku", "nu")
    return f"""{BASE}, fl AS MATERIALIZED ({_flags_sql()}), {K.boot('b', 'fl', ['family'], ['r', 'p', 'rp'])},
  c AS (SELECT family, {lo} AS lo, {hi} AS hi FROM b GROUP BY family),
  g AS (SELECT family, sum(r) AS nr, sum(rp) AS kr, sum(1 - r) AS nu, sum(p - rp) AS ku FROM fl GROUP BY family)
  SELECT family, nr::BIGINT AS n_raised, round(kr / nullif(nr, 0)::DOUBLE, 6) AS t, round({tlo}, 6) AS t_lo,
    round({thi}, 6) AS t_hi, nu::BIGINT AS n_unraised, round(ku / nullif(nu, 0)::DOUBLE, 6) AS i,
    round({ilo}, 6) AS i_lo, round({ihi}, 6) AS i_hi,
    round(kr / nullif(nr, 0)::DOUBLE - ku / nullif(nu, 0)::DOUBLE, 6) AS d, round(lo, 6) AS d_lo, round(hi, 6) AS d_hi
  FROM g JOIN c USING (family)"""


@query("v6_transmission", _v6())
def v6_transmission(t):
    return rounded(V.transmission(t.audited(), LEX))


def _v7() -> str:
    lo, hi = K.ci("mp / nullif(m, 0) - (p - mp) / nullif(n - m, 0)", "truncate")
    pieces = " UNION ALL ".join(
        f"SELECT '{f}' AS family, ((am & {1 << i}) <> 0)::INT + ((bm & {1 << i}) <> 0)::INT + ((cm & {1 << i}) <> 0)::INT AS k,"
        f" ((om & {1 << i}) <> 0)::INT AS p FROM ms" for i, f in enumerate(FAMS))
    ms = ", ".join(f"{K.mask(K.ascii_text(c), LEX)} AS {n}" for c, n in
                   (("output", "om"), ("alpha", "am"), ("beta", "bm"), ("gamma", "cm")))
    return f"""WITH {RUNS}, ms AS MATERIALIZED (SELECT {ms} FROM runs),
  k0 AS (SELECT * FROM ({pieces}) WHERE k > 0),
  kk AS MATERIALIZED (SELECT family, k, p, (k >= 2)::INT AS m, CASE WHEN k >= 2 THEN p ELSE 0 END AS mp FROM k0
     UNION ALL SELECT 'composite', k, p, (k >= 2)::INT, CASE WHEN k >= 2 THEN p ELSE 0 END FROM k0),
  {K.boot('b', '(SELECT family, m, p, mp FROM kk)', ['family'], ['m', 'p', 'mp'])},
  c AS (SELECT family, {lo} AS lo, {hi} AS hi FROM b GROUP BY family),
  g AS (SELECT family, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k >= 2) AS n2,
     avg(p) FILTER (k = 1) AS t1, avg(p) FILTER (k >= 2) AS tm, avg(p) FILTER (k = 2) AS r2, avg(p) FILTER (k = 3) AS r3
     FROM kk GROUP BY family),
  j AS (SELECT *, n1 >= 10 AND n2 >= 10 AS us FROM g JOIN c USING (family))
  SELECT family, n1 AS n_one, n2 AS n_multi, round(CASE WHEN us THEN t1 END, 6) AS t_one,
    round(CASE WHEN us THEN tm END, 6) AS t_multi, round(CASE WHEN us THEN tm - t1 END, 6) AS diff,
    round(CASE WHEN us THEN lo END, 6) AS diff_lo, round(CASE WHEN us THEN hi END, 6) AS diff_hi,
    CASE WHEN t1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL THEN t1 <= r2 + 0.05 AND r2 <= r3 + 0.05 END AS monotone,
    CASE WHEN NOT us THEN 'too thin' WHEN lo > 0 THEN 'higher when corroborated' WHEN hi < 0 THEN 'lower when corroborated'
      ELSE 'not distinguishable' END AS status FROM j"""


@query("v7_corroboration", _v7())
def v7_corroboration(t):
    return rounded(V.corroboration(t.runs, LEX))


_zlo, _zhi = K.wilson("k", "n")


@query("v8_zero_supply", f"""{BASE}, z AS (SELECT writer_id, count(*) FILTER (supply = 0) AS n,
   count(*) FILTER (supply = 0 AND emitted > 0) AS k FROM aud WHERE NOT floored GROUP BY 1)
 SELECT writer_id, n, k, CASE WHEN n >= 8 THEN round(k / n::DOUBLE, 6) END AS rate,
   CASE WHEN n >= 8 THEN round({_zlo}, 6) END AS rate_lo, CASE WHEN n >= 8 THEN round({_zhi}, 6) END AS rate_hi,
   CASE WHEN n >= 8 THEN 'evaluable' ELSE 'not evaluable' END AS status FROM z""")
def v8_zero_supply(t):
    return rounded(V.zero_supply(t.audited(), ["writer_id"]))


@query("v9_coupling", f"""WITH {RUNS}, m AS (SELECT {K.mask('l', LEX)} AS l, {K.mask('a', LEX)} AS a FROM (
    SELECT {K.ascii_text('alpha')} AS l, {K.ascii_text('output')} AS a FROM runs)),
  g AS (SELECT sum(bit_count(a)::INT)::BIGINT AS answer_families, sum(bit_count(l & a)::INT)::BIGINT AS coupled,
    count(*) FILTER (l = 0) AS empty_ledgers, count(*) FILTER (l = 0 AND a = 0) AS empty_and_bare FROM m)
  SELECT *, round(coupled / nullif(answer_families, 0)::DOUBLE, 6) AS rate,
   CASE WHEN answer_families = 0 THEN 'nothing to check'
     WHEN coupled / answer_families::DOUBLE >= 0.8 AND empty_ledgers = empty_and_bare THEN 'coupled'
     ELSE 'not coupled' END AS status FROM g""")
def v9_coupling(t):
    return rounded(V.coupling(t.dealt.select(F.col("alpha").alias("ledger"), F.col("output").alias("answer")), LEX))


@query("v20_instrument_divergence", f"""WITH m AS (SELECT {K.mask('t', 'prose')} AS a, {K.mask('t', 'prose_loose')} AS b
   FROM (SELECT {K.ascii_text('text')} AS t FROM documents)),
  f AS ({' UNION ALL '.join(f"SELECT '{f}' AS family, (a & {1 << i}) <> 0 AS ha, (b & {1 << i}) <> 0 AS hb, a = b AS same FROM m" for i, f in enumerate(FAMS))})
  SELECT family, count(*) AS n_texts, count(*) FILTER (ha AND hb) AS both, count(*) FILTER (ha AND NOT hb) AS only_a,
    count(*) FILTER (hb AND NOT ha) AS only_b, count(*) FILTER (same) AS same_set,
    round(count(*) FILTER (ha = hb) / count(*)::DOUBLE, 6) AS agreement FROM f GROUP BY family""")
def v20_instrument_divergence(t):
    return rounded(V.instrument_divergence(t.documents, "prose", "prose_loose"))


# Stored attempts: the draft is the full output, retry k drops the sentences behind position k.
_ATT = f"""WITH {RUNS}, att AS MATERIALIZED (
  SELECT run_id, 0 AS attempt, output AS o, up FROM runs UNION ALL
  SELECT run_id, 1, alpha || ' ' || beta, up FROM runs UNION ALL
  SELECT run_id, 2, alpha, up FROM runs),
 am AS (SELECT run_id, attempt, length(o) AS chars, {K.mask(K.ascii_text('up'), LEX)} AS raised,
    {K.mask(K.ascii_text('o'), LEX)} AS present FROM att),
 aa AS MATERIALIZED (SELECT *, CASE WHEN chars < 100 THEN 0 ELSE raised & present END AS kept,
    CASE WHEN chars < 100 THEN 0 ELSE {K.minus('present', 'raised')} END AS invented FROM am)"""


def _attempts(t):
    each = F.explode(F.array(
        F.struct(F.lit(0).alias("attempt"), F.col("output").alias("o")),
        F.struct(F.lit(1).alias("attempt"), F.concat_ws(" ", "alpha", "beta").alias("o")),
        F.struct(F.lit(2).alias("attempt"), F.col("alpha").alias("o"))))
    return t.dealt.select("run_id", F.array("alpha", "beta", "gamma").alias("upstream"), each.alias("e")).select(
        "run_id", "upstream", F.col("e.attempt").alias("attempt"), F.col("e.o").alias("output"))


@query("v4_gate_report", f"""{_ATT}, pick AS (SELECT run_id, coalesce(min(CASE WHEN invented = 0 THEN attempt END), max(attempt)) AS a
    FROM aa GROUP BY 1)
  SELECT p.run_id, bit_count(pre.raised)::INT AS supply, {K.names('pre.invented', LEX)} AS pre_invented,
   {K.names('pre.kept', LEX)} AS pre_kept, {K.names('post.invented', LEX)} AS residual, {K.names('post.kept', LEX)} AS post_kept,
   post.attempt AS retries, post.invented <> 0 AS annotated
  FROM pick p JOIN aa pre ON pre.run_id = p.run_id AND pre.attempt = 0
  JOIN aa post ON post.run_id = p.run_id AND post.attempt = p.a""")
def v4_gate_report(t):
    g = V.gate_report(_attempts(t), LEX, floor=100)
    for c in ("pre_invented", "pre_kept", "residual", "post_kept"):
        g = g.withColumn(c, F.array_join(X.mask_names(c, LEX), ","))
    return g


_note = f"{K.q(V.NOTE_HEAD)} || replace({K.names('invented', LEX)}, ',', ', ') || {K.q(V.NOTE_TAIL)}"


@query("v5_select_best", f"""{_ATT}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (chars >= 100)::INT DESC,
     bit_count(invented), bit_count(kept) DESC, chars DESC, attempt) AS rn,
     count(*) OVER (PARTITION BY run_id) AS ns,
     count(*) FILTER (chars >= 100 AND invented = 0) OVER (PARTITION BY run_id) AS nc FROM aa)
  SELECT r.run_id, r.attempt AS cand, bit_count(kept)::INT AS n_kept, ns AS n_sampled, nc AS n_clean,
    NOT (chars >= 100 AND invented = 0) AS annotated,
    md5(o || CASE WHEN chars < 100 THEN {K.q(V.NOTE_SHORT)} WHEN invented <> 0 THEN {_note} ELSE '' END) AS chosen
  FROM r JOIN att a ON a.run_id = r.run_id AND a.attempt = r.attempt WHERE rn = 1""")
def v5_select_best(t):
    best = V.select_best(_attempts(t).withColumnRenamed("attempt", "cand"), LEX, key="run_id", floor=100)
    return best.select("run_id", "cand", "n_kept", "n_sampled", "n_clean", "annotated", F.md5("chosen").alias("chosen"))


_seat_union = " UNION ALL ".join(f"SELECT run_id, '{s}' AS seat, {s} AS text FROM runs WHERE {s} <> ''"
                                 for s in ("alpha", "beta", "gamma"))


@query("v3_manifest_restored", f"""{BASE}, st AS (SELECT run_id, seat, unnest({K.sents_len('text', 31, None)}) AS s,
    generate_subscripts({K.sents_len('text', 31, None)}, 1) AS pos FROM ({_seat_union})),
  sm AS (SELECT run_id, seat, s, pos, {K.mask(K.ascii_text('s'), LEX)} AS m FROM st),
  h AS (SELECT x.run_id, x.seat, s, pos, m & discarded AS m FROM sm x JOIN aud a ON a.run_id = x.run_id
     WHERE (m & discarded) <> 0),
  e AS ({' UNION ALL '.join(f"SELECT run_id, seat, s, pos, '{f}' AS family FROM h WHERE (m & {1 << i}) <> 0" for i, f in enumerate(FAMS))})
  SELECT run_id, family, seat, arg_min(substr(s, 1, 400), pos) AS quote FROM e GROUP BY 1, 2, 3""")
def v3_manifest_restored(t):
    return V.manifest_restored(t.seats, t.audited().select("run_id", "discarded_mask"), LEX)


# Citations in the test prose do not occur, so outputs carry one built from the run's own figures.
_CIT = ("'Legal specialist notes ' || coalesce(nullif(regexp_extract(output, '[0-9][0-9,]+', 0), ''), 'it') "
        "|| '. Finance seat agrees.'")


@query("v3_citation_marks", f"""WITH {RUNS}, c AS (SELECT run_id, alpha, beta, output || ' ' || {_CIT} AS o FROM runs),
  x AS (SELECT run_id, alpha, beta, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT *,
     regexp_extract_all(o, '\\b(?:healthcare|clinical|medical|legal|financial|finance)\\s+(?:specialist|contribution|analysis|seat)\\b[^.]*?\\.', 0, 'i') AS l FROM c)),
  f AS (SELECT *, CASE WHEN lower(s) LIKE 'legal%' THEN 'legal' ELSE 'finance' END AS seat,
     regexp_extract_all(s, '\\$?\\d[\\d,\\.]+\\s?(?:k|K|%|m|M|bn|million|billion)?') AS figs FROM x),
  y AS (SELECT *, regexp_extract_all(CASE WHEN seat = 'legal' THEN alpha ELSE beta END, '\\$?\\d[\\d,\\.]+\\s?(?:k|K|%|m|M|bn|million|billion)?') AS held FROM f)
  SELECT run_id, (pos - 1)::INT AS pos, seat, CASE WHEN len(figs) = 0 THEN 'unchecked-qualitative'
    WHEN list_has_any(figs, held) THEN 'verified' ELSE 'unsupported' END AS status FROM y""")
def v3_citation_marks(t):
    figure = F.regexp_extract("output", "[0-9][0-9,]+", 0)
    cite = F.concat(F.lit("Legal specialist notes "), F.when(figure != "", figure).otherwise(F.lit("it")),
                    F.lit(". Finance seat agrees."))
    outputs = t.dealt.select("run_id", F.concat_ws(" ", "output", cite).alias("output"))
    seats = t.dealt.select("run_id", F.explode(F.array(
        F.struct(F.lit("legal").alias("seat"), F.col("alpha").alias("text")),
        F.struct(F.lit("finance").alias("seat"), F.col("beta").alias("text")))).alias("e")).select("run_id", "e.*")
    return V.citation_marks(outputs, seats).drop("sentence")
