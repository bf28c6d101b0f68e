"""Adapter and reshape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import provenance as V
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query
from ledgerloom.sources import ledger as L

W = f"WITH {K.DEALT}"
PARTS = "array_to_string(list_filter([alpha, beta, gamma], lambda x: x <> ''), '|')"


def envelopes(t):
    """Nested run envelopes assembled from the dealt runs, in the ledger's own schema."""
    empty = F.lit(None)
    def turn(seat, text):
        return F.struct(F.lit(seat).alias("seat"), text.alias("output_text"))
    r = F.col("run_id")
    turns = F.array(turn("alpha", F.col("alpha")), turn("beta", F.col("beta")), turn("alpha", F.col("gamma")))
    routes = F.when(r % 7 == 0, F.array().cast("array<string>")).when(r % 5 == 0, empty).otherwise(F.array(F.lit("alpha"), F.lit("beta")))
    delib = F.when(r % 11 != 0, F.struct(
        F.struct(routes.alias("routes")).alias("plan"), turns.alias("turns"),
        F.struct(F.array(F.struct(F.lit("system").alias("role"), F.col("alpha").alias("content"))).alias("input_messages")).alias("synthesis"),
        F.col("output").alias("final_output")))
    return t.dealt.select(
        r.cast("string").alias("run_id"), F.lit("bench").alias("source"), F.col("writer_id").alias("model"), F.col("condition").alias("mode"),
        F.col("prompt_id").cast("string").alias("case_id"), F.concat("output", F.lit(X.NOTE_DELIM + " note")).alias("final_output"),
        F.when(r % 3 == 0, F.col("beta")).alias("pre_gate_output"), F.lit("2026-01-01").alias("captured_at"),
        F.struct((r % 13 == 0).alias("quarantined"), F.array(F.lit("gate")).alias("routes")).alias("execution_path"), delib.alias("deliberation"))


@query("s1_read_ledger", f"""{W} SELECT run_id::VARCHAR AS run_id, prompt_id::VARCHAR AS prompt_id, md5({PARTS}) AS upstream,
   md5(CASE WHEN run_id % 3 = 0 AND beta <> '' THEN beta ELSE output END) AS output, md5(alpha) AS writer_prompt,
   CASE WHEN run_id % 5 = 0 THEN 'gate' ELSE 'alpha,beta' END AS routes, condition, writer_id FROM runs
  WHERE run_id % 13 <> 0 AND run_id % 11 <> 0 AND run_id % 7 <> 0 AND up <> ''""")
def s1_read_ledger(t):
    """Envelope semantics: quarantine, zero routes, missing deliberation, draft before note."""
    r = L.runs_of(envelopes(t))
    return r.select("run_id", "prompt_id", F.md5(F.array_join("upstream", "|")).alias("upstream"), F.md5("output").alias("output"),
                    F.md5("writer_prompt").alias("writer_prompt"), F.array_join("routes", ",").alias("routes"), "condition", "writer_id")


@query("s2_field_map", f"""{W} SELECT run_id::VARCHAR AS run_id, condition AS prompt_id, md5({PARTS}) AS upstream, md5(output) AS output,
   gamma AS writer_prompt, writer_id FROM runs""")
def s2_field_map(t):
    """Dotted paths into nested rows, with a negative list index."""
    rows = t.dealt.select(F.struct(
        F.col("run_id").alias("id"), F.struct(F.array("alpha", "beta", "gamma").alias("messages"), F.col("output").alias("final")).alias("state"),
        F.struct(F.col("condition").alias("task")).alias("meta"), F.col("writer_id").alias("w")).alias("row"))
    r = L.apply_fields(rows, L.FieldMap(upstream="row.state.messages", output="row.state.final", run_id="row.id", prompt_id="row.meta.task",
                                        writer_prompt="row.state.messages.-1", writer_id=lambda d: d["row"]["w"]))
    return r.select("run_id", "prompt_id", F.md5(F.array_join("upstream", "|")).alias("upstream"), F.md5("output").alias("output"),
                    "writer_prompt", "writer_id")


@query("s3_from_callable", "SELECT conv_id, turn, role, length(text)::INT AS chars FROM conversations WHERE role <> 'system'")
def s3_from_callable(t):
    return L.from_callable(t.conversations, lambda d: d.where("role <> 'system'").select("conv_id", "turn", "role", F.length("text").alias("chars")))


@query("s4_adapt_layers", f"""{W} SELECT run_id, md5(array_to_string(list_filter([beta, gamma], lambda x: x <> ''), '|')) AS upstream, md5(output) AS output,
   'proposer_0,proposer_1' AS routes, 'moa' AS condition FROM runs""")
def s4_adapt_layers(t):
    a = L.adapt_layers(t.dealt.select("run_id", F.array(F.array("alpha"), F.array("beta", "gamma")).alias("layers"), F.col("output").alias("final")))
    return a.select("run_id", F.md5(F.array_join("upstream", "|")).alias("upstream"), F.md5("output").alias("output"),
                    F.array_join("routes", ",").alias("routes"), "condition")


@query("s5_adapt_state", f"{W} SELECT run_id, prompt_id::VARCHAR AS prompt_id, md5({PARTS}) AS upstream, md5(output) AS output, 'node_0,node_1,node_2' AS routes FROM runs")
def s5_adapt_state(t):
    a = L.adapt_state(t.dealt.select("run_id", F.struct(
        F.array("alpha", "beta", "gamma").alias("specialist_outputs"), F.col("output").alias("final"), F.col("prompt_id").alias("task_id")).alias("state")))
    return a.select("run_id", "prompt_id", F.md5(F.array_join("upstream", "|")).alias("upstream"), F.md5("output").alias("output"),
                    F.array_join("routes", ",").alias("routes"))


@query("s6_adapt_chat", """WITH l AS (SELECT conv_id, max(turn) AS lt FROM conversations WHERE role = 'assistant' GROUP BY 1)
  SELECT c.conv_id AS run_id, turn AS pos, role = 'assistant' AS is_output, role AS route, length(text)::INT AS chars
  FROM conversations c JOIN l USING (conv_id) WHERE (role = 'assistant' AND turn = lt) OR (role <> 'assistant' AND turn < lt AND text <> '')""")
def s6_adapt_chat(t):
    return L.adapt_chat(t.conversations, "assistant").select("run_id", "pos", "is_output", "route", F.length("text").alias("chars"))


@query("s7_adapt_rag", f"{W} SELECT run_id, md5({PARTS}) AS upstream, 'chunk_0,chunk_1,chunk_2' AS routes, 'rag' AS condition FROM runs")
def s7_adapt_rag(t):
    a = L.adapt_rag(t.dealt.select("run_id", F.array("alpha", "beta", "gamma").alias("chunks"), F.col("output").alias("answer")))
    return a.select("run_id", F.md5(F.array_join("upstream", "|")).alias("upstream"), F.array_join("routes", ",").alias("routes"), "condition")


@query("s8_unwrap_envelope", f"""{W} SELECT run_id % 3 <> 0 AS wrapped, run_id % 4 <> 0 AS usable, count(*) AS n,
   sum(CASE WHEN run_id % 4 <> 0 THEN length(CASE WHEN run_id % 3 <> 0 THEN output ELSE alpha END) ELSE 0 END)::BIGINT AS chars FROM runs GROUP BY 1, 2""")
def s8_unwrap_envelope(t):
    """Wrapped logs, raw logs and logs without a final output, told apart and counted."""
    r = F.col("run_id")
    d = t.dealt.select(
        r, F.array(F.lit("legal")).alias("plan"), F.array("alpha").alias("turns"), F.when(r % 4 != 0, F.col("alpha")).alias("final_output"),
        F.when(r % 3 != 0, F.struct(F.array(F.lit("legal")).alias("plan"), F.array("beta").alias("turns"),
                                    F.when(r % 4 != 0, F.col("output")).alias("final_output"))).alias("deliberation"))
    ok, bad = L.unwrap_envelope(d)
    both = ok.select("wrapped", F.lit(True).alias("usable"), F.length("final_output").alias("c")).unionByName(
        bad.select("wrapped", F.lit(False).alias("usable"), F.lit(0).alias("c")))
    return both.groupBy("wrapped", "usable").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query("s9_turns", f"""{W} SELECT run_id, 'alpha' AS seat, 0 AS pos, md5(alpha) AS text FROM runs UNION ALL SELECT run_id, 'beta', 1, md5(beta) FROM runs""")
def s9_turns(t):
    """First turn per seat (the third turn repeats a seat and is left out)."""
    rows = t.dealt.select("run_id", F.array(
        F.struct(F.lit("alpha").alias("seat"), F.col("alpha").alias("output_text")), F.struct(F.lit("beta").alias("seat"), F.col("beta").alias("output_text")),
        F.struct(F.lit("alpha").alias("seat"), F.col("gamma").alias("output_text"))).alias("turns"))
    return L.turns(rows, ["run_id"]).select("run_id", "seat", "pos", F.md5("text").alias("text"))


_SENT = K.sents("text")
_TH = "regexp_matches(s, '\\bthe\\b', 'i')"


@query("s10_labels_long", f"""WITH u AS (SELECT doc_id, {_SENT} AS ss FROM documents), e AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM u)
  SELECT doc_id AS unit_id, i::INT AS sent_idx, j AS judge, 'article' AS family,
    CASE WHEN j = 'one' THEN regexp_matches({K.ascii_text('s')}, '\\bthe\\b', 'i') ELSE length(s) > 60 END AS value FROM e CROSS JOIN (VALUES ('one'), ('two')) v(j)""")
def s10_labels_long(t):
    """Judge caches keyed by batch offset, joined back to (unit, sentence) without a global window.

    The caches are built from the flattened sentences themselves, ten to a batch, as the judges were asked.
    """
    units = t.documents.select(F.col("doc_id").alias("unit_id"), X.sentences("text").alias("sentences"))
    # the judges answer where the sentences are: answers travel, texts do not
    answers = F.transform(X.sentences("text"), lambda s: F.struct(X.has(s, r"\bthe\b").alias("one"), (F.length(s) > 60).alias("two")))
    judged = X.held(t.documents.select(F.col("doc_id").alias("unit_id"), "text"), "v", answers).select("unit_id", "v")
    placed = L.global_offsets(judged, "unit_id", F.size("v"))
    flat = X.explode_rows(placed, ["offset"], F.col("v"), "i", "v").select(
        (F.col("offset") + F.col("i")).alias("g"), "v").withColumn("start", F.floor(F.col("g") / 10) * 10)
    at = (F.col("g") - F.col("start") + 1).cast("string")
    # a batch holds ten sentences, so the collected maps are bounded
    caches = flat.groupBy("start").agg(*[F.map_from_entries(F.collect_list(F.struct(
        at, F.create_map(F.lit("article"), F.col(f"v.{j}"))))).alias(j) for j in ("one", "two")])
    both = caches.select(F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), "start", F.col(j).alias("labels")) for j in ("one", "two")])).alias("e")).select("e.*")
    return L.labels_long(units, both)


@query("s11_items", """SELECT user_id, count(*) AS items, count(DISTINCT event_type) AS kinds, sum(CASE WHEN json_extract_string(props, '$.k')::INT >= 50 THEN 1 ELSE 0 END)::BIGINT AS high
  FROM events GROUP BY 1""")
def s11_items(t):
    """Dimension rows decoded from JSON text."""
    e = t.read("events").select("user_id", "event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("user_id").agg(F.count("*").alias("items"), F.count_distinct("event_type").alias("kinds"),
                                    F.count_if(F.col("p.k") >= 50).alias("high"))


@query("s13_bake_cases", """WITH r AS (SELECT doc_id % 50 AS case_id, lang, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id % 50, lang ORDER BY doc_id DESC) AS rn FROM documents)
  SELECT case_id, count(*)::INT AS modes, string_agg(lang || '={"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}', ';' ORDER BY lang) AS payload FROM r WHERE rn = 1 GROUP BY 1""")
def s13_bake_cases(t):
    """Newest run per case and mode, one payload row per case."""
    runs = t.read("documents").select((F.col("doc_id") % 50).alias("case_id"), "lang", "doc_id", "n_chars")
    b = L.bake_cases(runs, "case_id", "lang", ["doc_id"], ["doc_id", "n_chars"])
    return b.select("case_id", F.size("runs").alias("modes"), F.array_join(F.array_sort(F.transform(
        F.map_entries("runs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("payload"))


@query("w1_newest_run", """SELECT user_id, event_type, max(ts)::VARCHAR AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def w1_newest_run(t):
    """Newest event per (run, mode) by one struct maximum."""
    n = L.newest(t.read("events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")
    return n.select("user_id", "event_type", F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "").alias("ts"), "event_id")


@query("v1_audit_chat_parts", f"""WITH l AS (SELECT conv_id, max(turn) AS lt FROM conversations WHERE role = 'assistant' GROUP BY 1),
  m AS (SELECT c.conv_id, role = 'assistant' AS o, length(text) AS n, {K.mask(K.ascii_text('text'), 'prose')} AS m FROM conversations c JOIN l USING (conv_id)
     WHERE (role = 'assistant' AND turn = lt) OR (role <> 'assistant' AND turn < lt)),
  g AS (SELECT conv_id, coalesce(bit_or(CASE WHEN NOT o THEN m END), 0) AS up, coalesce(bit_or(CASE WHEN o THEN m END), 0) AS ou, sum(CASE WHEN o THEN n END) AS chars FROM m GROUP BY 1)
  SELECT conv_id AS run_id, bit_count(up)::INT AS supply, CASE WHEN chars < 200 THEN 0 ELSE bit_count(up & ou) END::INT AS n_kept FROM g""")
def v1_audit_chat_parts(t):
    """The chat adapter's long parts, audited with bit_or: agrees with the one-pass chat audit."""
    return V.audit_parts(L.adapt_chat(t.conversations, "assistant"), "prose", floor=200).select("run_id", "supply", "n_kept")
