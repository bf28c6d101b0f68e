"""Hygiene queries: validation, quarantine, text splitting, decoding, integrity, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import dictation as D
from ledgerloom.operators import hygiene as P
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded

W = f"WITH {K.DEALT}"
NL = "chr(10)"
_ROUTES = "(alpha <> '')::INT + (beta <> '')::INT + (gamma <> '')::INT"


def _records(t):
    return t.dealt.select(
        "run_id", "condition", "prompt_id", "output", F.array("alpha", "beta", "gamma").alias("upstream"),
        F.col("alpha").alias("writer_prompt"),
        F.filter(F.array(*[F.when(F.col(s) != "", F.lit(s)) for s in ("alpha", "beta", "gamma")]), lambda r: r.isNotNull()).alias("routes"))


_OUTP = ("CASE WHEN trim(output) = '' THEN 'empty output' WHEN length(output) < 500 THEN 'output ' || length(output) || ' chars < floor 500' END")
_UPP = "CASE WHEN up = '' THEN 'no upstream text captured' END"


@query("p1_validate", f"""{W} SELECT run_id, concat_ws('; ', 'fatal: ' || ({_OUTP}), 'fatal: ' || ({_UPP}),
   CASE WHEN alpha = '' THEN 'fatal: writer_prompt not captured (path assertion impossible)' END) AS problems FROM runs""")
def p1_validate(t):
    v = P.validate(_records(t), require_writer_prompt=True)
    return v.select("run_id", F.array_join(F.transform(
        "problems", lambda p: F.concat(p["severity"], F.lit(": "), p["message"])), "; ").alias("problems"))


@query("p2_partition_dropped", f"""{W}, r AS (SELECT coalesce({_OUTP}, {_UPP}) AS reason FROM runs)
  SELECT reason, count(*) AS n, regexp_replace(reason, '^output [0-9]+ chars', 'output') AS normalised FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def p2_partition_dropped(t):
    return P.partition(_records(t))[1]


@query("p2_partition_usable", f"{W} SELECT condition, count(*) AS n, sum(length(output))::BIGINT AS chars FROM runs WHERE length(output) >= 500 AND up <> '' GROUP BY 1")
def p2_partition_usable(t):
    return P.partition(_records(t))[0].groupBy("condition").agg(F.count("*").alias("n"), F.sum(F.length("output")).alias("chars"))


_PATH = f"""CASE WHEN {_ROUTES} < 2 THEN 'routes=' || ({_ROUTES}) || ' < required 2'
   WHEN NOT contains(alpha, 'e') THEN 'writer prompt lacks required marker ''e'''
   WHEN contains(alpha, 'und') THEN 'writer prompt contains forbidden marker ''und''' END"""


@query("p3_assert_path", f"{W} SELECT run_id, {_PATH} AS reason, ({_PATH}) IS NOT NULL AS quarantined FROM runs")
def p3_assert_path(t):
    return P.assert_path(_records(t), 2, "e", "und").select("run_id", "reason", "quarantined")


@query("p4_audit_paths", f"""{W}, a AS (SELECT condition, ({_PATH}) IS NOT NULL AS q FROM runs)
  SELECT condition, count(*) AS n, count(*) FILTER (q) AS quarantined, round(avg(q::INT), 6) AS rate FROM a GROUP BY 1""")
def p4_audit_paths(t):
    return rounded(P.audit_paths(P.assert_path(_records(t), 2, "e", "und"), ["condition"]))


@query("p5_classify_path", f"""{W} SELECT CASE WHEN alpha = '' THEN 'unknown' WHEN contains(alpha, 'tion') THEN 'preserve applied'
   WHEN contains(alpha, 'heit') THEN 'direct answer' ELSE 'custom override' END AS path, count(*) AS n FROM runs GROUP BY 1""")
def p5_classify_path(t):
    label = P.classify_path("alpha", [("tion", "preserve applied"), ("heit", "direct answer")])
    return t.dealt.groupBy(label.alias("path")).agg(F.count("*").alias("n"))


@query("p6_strip_note", f"""{W} SELECT run_id, md5(CASE WHEN run_id % 3 = 1 THEN output || {K.q(X.NOTE_DELIM)} || ' first' ELSE output END) AS kept FROM runs""")
def p6_strip_note(t):
    """Notes appended to two thirds of the outputs (one run in three carries two) and cut at the last."""
    noted = F.when(F.col("run_id") % 3 == 0, F.concat("output", F.lit(X.NOTE_DELIM + " note"))).when(
        F.col("run_id") % 3 == 1, F.concat("output", F.lit(X.NOTE_DELIM + " first" + X.NOTE_DELIM + " second"))).otherwise(F.col("output"))
    return t.dealt.select("run_id", F.md5(X.strip_note(noted)).alias("kept"))


@query("p7_strip_thinking", f"""{W} SELECT run_id, md5(CASE WHEN run_id % 3 = 2 THEN gamma ELSE output || gamma END) AS spoken,
   CASE WHEN run_id % 3 = 2 THEN 0 ELSE 2 END AS blocks, md5(CASE WHEN run_id % 3 = 2 THEN alpha || '</think>' || gamma ELSE output || gamma END) AS spoken_paired FROM runs""")
def p7_strip_thinking(t):
    """Paired reasoning blocks, and the unopened closing tag of the other rule."""
    raw = F.when(F.col("run_id") % 3 == 2, F.concat("alpha", F.lit("</think>"), "gamma")).otherwise(F.concat(
        F.lit("<think>"), "alpha", F.lit("</think>"), "output", F.lit("<think>"), "beta", F.lit("</think>"), "gamma"))
    return t.dealt.select(
        "run_id", F.md5(X.strip_thinking(raw)).alias("spoken"), F.size(X.thinking(raw)).alias("blocks"),
        F.md5(X.strip_thinking(raw, unopened=False)).alias("spoken_paired"))


_b8 = "array_to_string(list_filter([CASE WHEN run_id % 2 = 0 THEN nullif(regexp_replace(alpha, '^\\s+|\\s+$', '', 'g'), '') END, CASE WHEN run_id % 3 = 0 THEN nullif(regexp_replace(beta, '^\\s+|\\s+$', '', 'g'), '') END], lambda x: x IS NOT NULL), '||')"


@query("p8_thinking_blocks", f"{W} SELECT run_id, md5({_b8}) AS blocks FROM runs")
def p8_thinking_blocks(t):
    """Typed content blocks and message-level traces of raw responses."""
    raw = F.to_json(F.struct(
        F.array(F.struct(F.when(F.col("run_id") % 2 == 0, "thinking").otherwise("text").alias("type"), F.col("alpha").alias("thinking")),
                F.struct(F.lit("text").alias("type"), F.col("output").alias("thinking"))).alias("content"),
        F.struct(F.when(F.col("run_id") % 3 == 0, F.col("beta")).alias("thinking")).alias("message")))
    return t.dealt.select("run_id", F.md5(F.array_join(P.thinking_blocks(raw), "||")).alias("blocks"))


@query("p9_split_protocol", f"""SELECT source, count(*) AS n, count(*) FILTER (NOT contains(text, {NL})) AS violations,
   sum(CASE WHEN contains(text, {NL}) THEN strpos(text, {NL}) - 1 ELSE 0 END)::BIGINT AS ledger_chars,
   sum(CASE WHEN contains(text, {NL}) THEN length(regexp_replace(substr(text, strpos(text, {NL}) + 1), '^\\s+|\\s+$', '', 'g')) END)::BIGINT AS answer_chars
  FROM documents GROUP BY 1""")
def p9_split_protocol(t):
    """First line as the ledger part, the rest as the answer; one-line texts violate the protocol."""
    s = P.split_protocol(t.documents, "text", "\n")
    return s.groupBy("source").agg(F.count("*").alias("n"), F.count_if("violation").alias("violations"),
                                   F.sum(F.length("ledger")).alias("ledger_chars"), F.sum(F.length("answer")).alias("answer_chars"))


_al = K.sents("alpha")


@query("p10_tensions", f"""{W}, b AS (SELECT run_id, list_filter(list_transform({_al}, lambda s: '- ' || regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 25) AS bl, output FROM runs)
  SELECT run_id, len(bl)::INT AS n, coalesce(list_sum(list_transform(bl, lambda s: length(regexp_replace(s, '^[-* ]+', '')))), 0)::BIGINT AS chars,
   md5(regexp_replace(output, '^\\s+|\\s+$', '', 'g')) AS synthesis FROM b""")
def p10_tensions(t):
    """Tension bullets and synthesis of reports assembled from each run."""
    report = F.concat(F.lit("Intro\n## Tensions\n"), F.array_join(F.transform(
        X.sentences("alpha"), lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("\n\n## Synthesis\n"), F.col("output"))
    bullets, synth = P.split_tensions(F.col("report"))
    d = t.dealt.select("run_id", report.alias("report")).select("run_id", bullets.alias("b"), synth.alias("s"))
    return d.select("run_id", F.size("b").alias("n"), F.aggregate(
        "b", F.lit(0).cast("bigint"), lambda a, e: a + F.length(e)).alias("chars"), F.md5("s").alias("synthesis"))


_TR = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("p10_sections", f"""{W} SELECT run_id, 'Findings' AS section, md5({_TR.format('alpha')}) AS body FROM runs UNION ALL
  SELECT run_id, 'Risks', md5({_TR.format('beta')}) FROM runs UNION ALL SELECT run_id, 'Answer', md5({_TR.format('output')}) FROM runs""")
def p10_sections(t):
    text = F.concat(F.lit("Preamble\n## Findings\n"), "alpha", F.lit("\nRisks\n"), "beta", F.lit("\n  ## Answer  \n"), "output")
    s = P.sections(t.dealt.select("run_id", text.alias("text")), ["run_id"], "text", ["Findings", "Risks", "Answer"])
    return s.select("run_id", "section", F.md5("body").alias("body"))


@query("p10_heading_buckets", f"""{W} SELECT run_id, 'legal' AS bucket, md5({_TR.format(f"'Legal view' || {NL} || beta")}) AS body FROM runs UNION ALL
  SELECT run_id, 'synthesis', md5(CASE WHEN {_TR.format('alpha')} <> '' THEN {_TR.format('alpha')} || {NL} || {NL} ELSE '' END || {_TR.format(f"'Summary' || {NL} || output")}) FROM runs""")
def p10_heading_buckets(t):
    text = F.concat("alpha", F.lit("\nLegal view\n"), "beta", F.lit("\nSummary\n"), "output")
    b = P.heading_buckets(t.dealt.select("run_id", text.alias("text")), ["run_id"], "text",
                          {"Legal view": "legal", "Summary": "synthesis"})
    return b.select("run_id", "bucket", F.md5("body").alias("body"))


@query("p10_prompt_blocks", f"""{W} SELECT run_id, md5(alpha || {NL} || beta) AS blocks, CASE WHEN alpha = '' THEN {_TR.format("'Finance sub-question: ' || beta")} ELSE {_TR.format('alpha')} END AS legal_q,
   CASE WHEN beta = '' THEN 'Specialists consulted: two' ELSE {_TR.format('beta')} END AS finance_q FROM runs""")
def p10_prompt_blocks(t):
    """Contribution blocks of synthesis prompts and labelled sub-questions (an empty one runs on to the next label)."""
    prompt = F.concat(F.lit("Head\n---\nLEGAL CONTRIBUTION:\n"), "alpha", F.lit("\n---\nFINANCE CONTRIBUTION:\n"), "beta")
    subs = P.sub_questions(F.concat(F.lit("Legal sub-question: "), "alpha", F.lit("\nFinance sub-question: "), "beta",
                                    F.lit("\nSpecialists consulted: two")), ["legal", "finance"])
    return t.dealt.select("run_id", F.md5(P.contribution_blocks(prompt)).alias("blocks"), subs["legal"].alias("legal_q"),
                          subs["finance"].alias("finance_q"))


@query("p11_decode_plans", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'legal' WHEN 1 THEN 'legal,finance' WHEN 2 THEN 'healthcare' WHEN 3 THEN 'legal,finance' WHEN 4 THEN '' ELSE '' END AS routes,
   doc_id % 6 = 5 AS parse_failure, CASE doc_id % 6 WHEN 1 THEN 'finance' WHEN 2 THEN 'healthcare' WHEN 3 THEN 'finance' ELSE '' END AS fallbacks,
   md5(CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN 'ask' || '|' || text WHEN 2 THEN text WHEN 3 THEN 'deep' || '|' || text ELSE '' END) AS questions FROM documents""")
def p11_decode_plans(t):
    """Six raw shapes: strict, fenced, trailing flat object, nested, unknown routes only, no JSON."""
    d = t.documents
    k = F.col("doc_id") % 6
    strict = F.concat(F.lit('{"routes": ["legal", "cooking"], "sub_questions": {"legal": "'), "source", F.lit('"}}'))
    raw = (F.when(k == 0, strict)
           .when(k == 1, F.lit('Sure:\n```json\n{"routes": ["legal", "finance"], "sub_questions": {"legal": "ask"}}\n```\nend'))
           .when(k == 2, F.lit('Think {not json} first. {"routes": ["healthcare"]} done'))
           .when(k == 3, F.lit('Plan: {"routes": ["legal", "finance"], "sub_questions": {"legal": " deep ", "finance": " "}, "requires_recency_disclosure": true} ok'))
           .when(k == 4, F.lit('{"routes": ["cooking"]}')).otherwise(F.lit("no plan at all")))
    p = P.decode_plans(d.select("doc_id", "text", raw.alias("raw")), "raw", "text", ["healthcare", "legal", "finance"])
    return p.select("doc_id", F.array_join("routes", ",").alias("routes"), "parse_failure", F.array_join("fallbacks", ",").alias("fallbacks"),
                    F.md5(F.array_join(F.transform("routes", lambda r: F.try_element_at(F.col("sub_questions"), r)), "|")).alias("questions"))


@query("p13_ground_quotes", f"""{W}, s AS (SELECT run_id, list_filter({_al}, lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 15) AS q FROM runs)
  SELECT run_id, len(q)::INT AS quotes_checked, run_id % 4 <> 0 OR len(q) = 0 AS verified FROM s""")
def p13_ground_quotes(t):
    """Quotes are a seat's sentences; every fourth run quotes words the text does not hold."""
    kept = F.filter(X.sentences("alpha"), lambda s: F.length(X.strip(s)) >= 15)
    d = t.dealt.select("run_id", "alpha", F.when(F.col("run_id") % 4 == 0, F.transform(kept, lambda s: F.concat(s, F.lit(" QQXZ"))))
                       .otherwise(X.sentences("alpha")).alias("q"))
    return P.ground_quotes(d, "q", "alpha").select("run_id", "quotes_checked", "verified")


@query("p14_leak_screen", """WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS w FROM benchmark),
  hit AS (SELECT DISTINCT doc_id FROM documents d, terms WHERE contains(lower(d.text), w))
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)""")
def p14_leak_screen(t):
    """Documents free of every long benchmark word (as a substring, case-folded)."""
    terms = t.read("benchmark").select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{12,}"), F.lit(0))).alias("phrase"))
    terms = terms.where("phrase is not null").distinct().withColumn("id", F.col("phrase"))
    hits = D.literal_hits(t.documents, ["doc_id"], "text", terms)
    return t.documents.select("doc_id").join(hits.select("doc_id").distinct(), "doc_id", "left_anti")


@query("p15_hold_out", f"""{W} SELECT run_id FROM runs WHERE length(output) >= 800 AND prompt_id NOT IN (SELECT item_id FROM benchmark)""")
def p15_hold_out(t):
    return P.hold_out(t.dealt, t.read("benchmark").select(F.col("item_id").alias("prompt_id")), "prompt_id").select("run_id")


_PROBE = "[lower(regexp_extract(output, '[a-z]{7,}', 0)), lower(regexp_extract(gamma, '[a-z]{7,}', 0))]"


@query("p16_guard_items", f"""{W}, i AS (SELECT run_id, {_PROBE} AS ps, lower(alpha || ' ' || beta) AS prem, length(alpha) / greatest(length(beta), 1)::DOUBLE AS rt FROM runs),
  p AS (SELECT run_id, unnest(ps) AS probe, generate_subscripts(ps, 1) AS k, prem FROM i)
  SELECT run_id, 'probe ' || k AS violation FROM p WHERE probe <> '' AND contains(prem, probe)
  UNION ALL SELECT run_id, 'length ratio' FROM i WHERE rt < 0.85 OR rt > 1.15""")
def p16_guard_items(t):
    """Construction guards as violation rows: probes inside their own premises, unmatched filler lengths."""
    d = t.dealt
    probes = F.array(F.lower(F.regexp_extract("output", "[a-z]{7,}", 0)), F.lower(F.regexp_extract("gamma", "[a-z]{7,}", 0)))
    prem = F.lower(F.concat_ws(" ", "alpha", "beta"))
    found = F.filter(F.transform(probes, lambda p, i: F.when((p != "") & F.contains(prem, p), F.concat(F.lit("probe "), (i + 1).cast("string")))),
                     lambda v: v.isNotNull())
    ratio = F.length("alpha") / F.greatest(F.length("beta"), F.lit(1))
    both = F.concat(found, F.when((ratio < 0.85) | (ratio > 1.15), F.array(F.lit("length ratio"))).otherwise(F.array().cast("array<string>")))
    return d.select("run_id", F.explode_outer(both).alias("violation")).where("violation is not null")


def calls(t):
    """Model calls bound to the event table: tokens from the event's value."""
    v = F.floor(F.col("value") * 100).cast("bigint")
    return t.read("events").select(
        F.col("user_id").cast("string").alias("ledger_id"), "ts", F.col("event_id").alias("seq"), v.alias("input_tokens"),
        F.floor(v / 3).cast("bigint").alias("cached_input_tokens"), F.floor(v / 5).cast("bigint").alias("output_tokens"))


CALLS = """cl AS MATERIALIZED (SELECT user_id::VARCHAR AS ledger_id, ts, event_id AS seq, i, floor(i / 3)::BIGINT AS c, floor(i / 5)::BIGINT AS o
    FROM (SELECT *, floor(value * 100)::BIGINT AS i FROM events)),
  cost AS MATERIALIZED (SELECT ledger_id, ts, seq, (((i - c) * 5.00::DECIMAL(10,2) / 1000000)::DECIMAL(18,8) + (c * 0.50::DECIMAL(10,2) / 1000000)::DECIMAL(18,8)
     + (o * 25.00::DECIMAL(10,2) / 1000000)::DECIMAL(18,8))::DECIMAL(18,8) AS cost FROM cl)"""


@query("p17_call_cost", f"WITH {CALLS} SELECT ledger_id, count(*) AS n, round(sum(cost), 4)::DOUBLE AS usd FROM cost GROUP BY 1")
def p17_call_cost(t):
    c = P.call_cost(calls(t))
    return c.groupBy("ledger_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).cast("double").alias("usd"))


@query("p18_duplicates", """SELECT lang, md5(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS digest, count(*) AS copies
  FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def p18_duplicates(t):
    return P.integrity_duplicates(t.documents, ["lang"], "text")


@query("p18_coverage", f"""{W} SELECT condition, count(*) AS runs, count(*) FILTER (length(output) < 50) AS short_runs, count(DISTINCT prompt_id) AS cases FROM runs GROUP BY 1""")
def p18_coverage(t):
    return P.integrity_coverage(t.dealt, "condition", "prompt_id", "output")


_bk = "[{'p': 'alpha', 'b': CASE WHEN run_id % 3 = 0 THEN 'ollama' ELSE writer_id END}, {'p': 'beta', 'b': CASE WHEN run_id % 2 = 0 THEN 'ollama' ELSE writer_id END}, {'p': 'lead', 'b': CASE WHEN run_id % 5 = 0 THEN 'other' ELSE writer_id END}]"


@query("p19_composition", f"""{W}, e AS (SELECT run_id, unnest({_bk}) AS s FROM runs), x AS (SELECT run_id, s.p AS p, s.b AS b FROM e),
  g AS (SELECT run_id, b, string_agg(p, ', ' ORDER BY p) AS ph FROM x WHERE b <> 'ollama' GROUP BY 1, 2),
  l AS (SELECT run_id, string_agg(b || ': ' || ph, ' / ' ORDER BY b || ': ' || ph) AS label, count(*) AS tags FROM g GROUP BY 1),
  k AS (SELECT run_id, count(*) FILTER (b <> 'ollama') AS sw FROM x GROUP BY 1)
  SELECT k.run_id, CASE WHEN sw = 0 THEN 'default' WHEN sw = 3 AND tags = 1 THEN 'uniform' ELSE 'swapped' END AS kind, coalesce(label, '') AS label
  FROM k LEFT JOIN l USING (run_id)""")
def p19_composition(t):
    b = F.create_map(F.lit("alpha"), F.when(F.col("run_id") % 3 == 0, "ollama").otherwise(F.col("writer_id")),
                     F.lit("beta"), F.when(F.col("run_id") % 2 == 0, "ollama").otherwise(F.col("writer_id")),
                     F.lit("lead"), F.when(F.col("run_id") % 5 == 0, "other").otherwise(F.col("writer_id")))
    return P.composition(t.dealt.select("run_id", b.alias("backends")), "run_id", "backends")
