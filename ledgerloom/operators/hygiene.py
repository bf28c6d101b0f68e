"""Validation, quarantine, text hygiene and integrity of run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.dictation import literal_hits


def problems(min_output_chars: int = 500, require_writer_prompt: bool = False) -> Column:
    """Array of (severity, message) per run record; empty means clean."""
    blank = F.coalesce(X.strip("output") == "", F.lit(True))
    n = F.length("output")
    def at(sev, msg):
        return F.struct(F.lit(sev).alias("severity"), (F.lit(msg) if isinstance(msg, str) else msg).alias("message"))
    checks = [
        F.when(blank, at("fatal", "empty output")).when(n < min_output_chars, at(
            "fatal", F.concat(F.lit("output "), n.cast("string"), F.lit(f" chars < floor {min_output_chars}")))),
        F.when(~F.exists("upstream", lambda t: F.coalesce(X.strip(t) != "", F.lit(False))),
               at("fatal", "no upstream text captured")),
    ]
    if require_writer_prompt:
        checks.append(F.when(F.coalesce(X.strip("writer_prompt") == "", F.lit(True)),
                             at("fatal", "writer_prompt not captured (path assertion impossible)")))
    checks.append(F.when(F.coalesce(F.col("prompt_id").cast("string") == "", F.lit(True)),
                         at("warn", "no prompt_id: best-of-n estimation unavailable")))
    return F.array_compact(F.array(*checks))


def validate(runs: DataFrame, **kw) -> DataFrame:
    return runs.withColumn("problems", problems(**kw))


def first_fatal(found) -> Column:
    """The first fatal message cut at "(" or ":"; null for usable runs."""
    fatal = F.filter(X.as_col(found), lambda p: p["severity"] == "fatal")
    return X.strip(F.regexp_extract(F.get(fatal, F.lit(0))["message"], r"^[^(:]*", 0))


def partition(runs: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(usable runs, dropped-reason counts). The counts carry a normalised reason beside the exact one."""
    v = validate(runs, **kw).withColumn("_reason", first_fatal("problems"))
    usable = v.where(F.col("_reason").isNull()).drop("_reason", "problems")
    # usable runs fall out after counting: a filter before it would repeat the text checks below the exchange
    dropped = v.groupBy(F.col("_reason").alias("reason")).agg(F.count("_reason").alias("n")).where("n > 0").withColumn(
        "normalised", F.regexp_replace("reason", r"^output \d+ chars", "output"))
    return usable, dropped


def assert_path(runs: DataFrame, min_routes: int = 1, require: str | None = None, forbid: str | None = None) -> DataFrame:
    """Quarantine reason by precedence: too few routes, required marker absent, forbidden marker present."""
    n = F.size("routes")
    reason = F.when(n < min_routes, F.concat(F.lit("routes="), n.cast("string"), F.lit(f" < required {min_routes}")))
    if require:
        reason = reason.when(~F.contains("writer_prompt", F.lit(require)),
                             F.lit(f"writer prompt lacks required marker {require!r}"))
    if forbid:
        reason = reason.when(F.contains("writer_prompt", F.lit(forbid)),
                             F.lit(f"writer prompt contains forbidden marker {forbid!r}"))
    return runs.withColumn("reason", reason).withColumn("quarantined", F.col("reason").isNotNull())


def audit_paths(asserted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs, quarantined runs and rate per reason group."""
    return asserted.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("quarantined").alias("quarantined"),
        F.avg(F.col("quarantined").cast("int")).alias("rate"))


def classify_path(prompt, markers: Sequence[tuple[str, str]], default: str = "custom override") -> Column:
    """Label of the first marker a prompt contains; unknown when it is empty."""
    p = X.as_col(prompt)
    out = F.when(F.coalesce(p, F.lit("")) == "", "unknown")
    for marker, label in markers:
        out = out.when(F.contains(p, F.lit(marker)), label)
    return out.otherwise(default)


def split_protocol(df: DataFrame, text: str, delim: str) -> DataFrame:
    """Ledger part before the first delimiter, answer part after it; without one a counted violation."""
    at = F.instr(X.as_col(text), delim)
    hit = at > 0
    return df.withColumn("violation", ~hit).withColumn(
        "ledger", F.when(hit, F.substr(X.as_col(text), F.lit(1), at - 1)).otherwise(F.lit(""))).withColumn(
        "answer", F.when(hit, X.strip(F.substr(X.as_col(text), at + len(delim), F.length(X.as_col(text))))))


def split_tensions(text) -> tuple[Column, Column]:
    """(bullets, synthesis) of a report with '## Tensions' and '## Synthesis'; empty when absent."""
    t = X.as_col(text)
    has = F.contains(t, F.lit("## Tensions"))
    after = F.substr(t, F.instr(t, "## Tensions") + len("## Tensions"), F.length(t))
    named = F.contains(after, F.lit("## Synthesis"))
    other = F.contains(after, F.lit("\n## "))
    cut_at = F.when(named, F.instr(after, "## Synthesis")).when(other, F.instr(after, "\n## "))
    width = F.when(named, F.lit(len("## Synthesis"))).otherwise(F.lit(len("\n## ")))
    block = F.substr(after, F.lit(1), cut_at - 1)
    synth = X.strip(F.substr(after, cut_at + width, F.length(after)))
    lines = F.transform(F.split(block, "\n", -1), X.strip)
    keep = F.filter(lines, lambda s: F.substring(s, 1, 1).isin("-", "*") & (F.length(s) > 25))
    bullets = F.transform(keep, lambda s: X.strip(F.regexp_replace(s, r"^[-* ]+", "")))
    ok = has & (named | other)
    return (F.when(ok, bullets).otherwise(F.array().cast("array<string>")), F.when(ok, synth).otherwise(F.lit("")))


def sections(df: DataFrame, keep: Sequence[str], text: str, headings: Sequence[str]) -> DataFrame:
    """Named whole-line sections of a text: one row per (keep..., section, body), the last of a name wins.

    Lines stay in the row: heading positions are found in the line array and bodies are slices of it.
    """
    wanted = F.array(*[F.lit(h) for h in headings])
    lines = df.select(*keep, F.split(X.as_col(text), "\n", -1).alias("_l"))
    names = F.transform("_l", lambda s: X.strip(F.regexp_replace(X.strip(s), r"^##\s*", "")))
    marked = lines.select(*keep, "_l", F.filter(
        F.transform(names, lambda s, i: F.struct((i + 1).alias("at"), s.alias("name"))),
        lambda e: F.array_contains(wanted, e["name"])).alias("_h"))
    body = F.transform("_h", lambda h, i: F.struct(
        h["at"].alias("at"), h["name"].alias("section"),
        X.strip(F.array_join(F.slice(
            F.col("_l"), h["at"] + 1,
            F.coalesce(F.get(F.col("_h"), i + 1)["at"], F.size("_l") + 1) - h["at"] - 1), "\n")).alias("body")))
    rows = X.explode_rows(marked, keep, body, "pos", "e").select(*keep, "e.*")
    return rows.groupBy(*keep, "section").agg(F.max_by("body", "at").alias("body"))


def heading_buckets(df: DataFrame, keep: Sequence[str], text: str, mapping: Mapping[str, str],
                    into: str = "synthesis") -> DataFrame:
    """Map whole-line headings to buckets; text before the first heading goes in front of the `into` bucket."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    lines = df.select(*keep, F.split(X.as_col(text), "\n", -1).alias("_l"))
    marked = lines.select(*keep, "_l", F.filter(
        F.transform("_l", lambda s, i: F.struct((i + 1).alias("at"), F.try_element_at(table, s).alias("bucket"))),
        lambda e: e["bucket"].isNotNull()).alias("_h"))
    heads = F.concat(F.array(F.struct(F.lit(1).alias("at"), F.lit("intro").alias("bucket"))), F.col("_h"))
    marked = marked.select(*keep, "_l", heads.alias("_h"))
    chunk = F.transform("_h", lambda h, i: F.struct(h["bucket"].alias("bucket"), i.alias("i"), X.strip(F.array_join(F.slice(
        F.col("_l"), h["at"], F.coalesce(F.get(F.col("_h"), i + 1)["at"], F.size("_l") + 1) - h["at"]), "\n")).alias("chunk")))
    rows = X.explode_rows(marked, keep, chunk, "pos", "e").select(*keep, "e.*").where("chunk <> ''")
    rows = rows.withColumn("_first", F.when(F.col("bucket") == "intro", 0).otherwise(1)).withColumn(
        "bucket", F.when(F.col("bucket") == "intro", into).otherwise(F.col("bucket")))
    # chunks of one text and bucket are bounded by the text itself
    return rows.groupBy(*keep, "bucket").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_first", "i", "chunk"))), lambda e: e["chunk"]), "\n\n").alias("body"))


def contribution_blocks(prompt) -> Column:
    """The specialists' blocks of a synthesis prompt, joined by newlines."""
    parts = F.split(X.as_col(prompt), r"\n---\n\w+ CONTRIBUTION:\n", -1)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), "\n")).otherwise(F.lit(""))


def sub_questions(text, seats: Sequence[str]) -> Column:
    """Map seat -> its labelled sub-question, up to the next label or closing marker."""
    stop = r"(?=\n[A-Z][\w/ ]+ sub-question:|\nRecency-sensitive\??:|\nSpecialists consulted:|\z)"
    return F.create_map(*[x for s in seats for x in (F.lit(s), X.strip(F.regexp_extract(
        X.as_col(text), rf"(?is){s} sub-question:\s*(.*?){stop}", 1)))])


def thinking_blocks(raw) -> Column:
    """Reasoning blocks of a raw response: typed content blocks, then the message-level trace."""
    r = X.as_col(raw)
    content = F.from_json(F.get_json_object(r, "$.content"), "array<struct<type:string,thinking:string,text:string>>")
    typed = F.transform(
        F.filter(content, lambda b: (b["type"] == "thinking")
                 & (F.coalesce(F.nullif(b["thinking"], F.lit("")), b["text"], F.lit("")) != "")),
        lambda b: X.strip(F.coalesce(F.nullif(b["thinking"], F.lit("")), b["text"])))
    trace = X.strip(F.get_json_object(r, "$.message.thinking"))
    own = F.when(F.coalesce(trace, F.lit("")) != "", F.array(trace)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.coalesce(typed, F.array().cast("array<string>")), own)


PLAN_JSON = "routes array<string>, sub_questions map<string,string>, requires_recency_disclosure boolean, recency_notes string"


def decode_plans(turns: DataFrame, raw: str, query: str, valid: Sequence[str]) -> DataFrame:
    """Planner output to routes and sub-questions: whole JSON, fenced block, last flat object, outer braces.

    Unknown routes are dropped, missing sub-questions fall back to the query and the fallbacks are listed.
    """
    t = X.as_col(raw)
    flat = F.filter(F.regexp_extract_all(t, F.lit(r"(?s)\{.*?\}"), F.lit(0)),
                    lambda c: F.try_parse_json(c).isNotNull())
    wide = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    def ok(c):
        return F.when(F.try_parse_json(c).isNotNull() & F.startswith(c, F.lit("{")), c)
    pick = F.coalesce(ok(X.strip(t)), ok(F.nullif(fenced, F.lit(""))), F.try_element_at(flat, F.lit(-1)),
                      ok(F.nullif(wide, F.lit(""))))
    plan = turns.withColumn("_json", pick).withColumn("_p", F.from_json("_json", PLAN_JSON))
    known = F.array(*[F.lit(v) for v in valid])
    routes = F.filter(F.coalesce("_p.routes", F.array().cast("array<string>")), lambda r: F.array_contains(known, r))
    plan = plan.withColumn("routes", routes).withColumn("parse_failure", F.col("_json").isNull())
    given = lambda r: X.strip(F.try_element_at(F.col("_p.sub_questions"), r))
    missing = F.filter("routes", lambda r: F.coalesce(given(r), F.lit("")) == "")
    subs = F.map_from_arrays("routes", F.transform(
        "routes", lambda r: F.coalesce(F.nullif(given(r), F.lit("")), F.col(query))))
    return plan.withColumn("fallbacks", missing).withColumn("sub_questions", subs).withColumn(
        "requires_recency", F.coalesce("_p.requires_recency_disclosure", F.lit(False))).drop("_json", "_p")


def ground_quotes(df: DataFrame, quotes: str, text: str, min_len: int = 15, rule: str = "markup") -> DataFrame:
    """Every quote of at least 15 characters must occur in its text after normalisation."""
    used = F.transform(F.filter(quotes, lambda q: F.length(X.strip(q)) >= min_len), lambda q: X.norm(q, rule))
    return df.withColumn("quotes_checked", F.size(used)).withColumn(
        "verified", X.let(X.norm(text, rule), lambda body: F.forall(used, lambda q: F.contains(body, q))))


def leak_screen(prompts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """The prompts that hold no reserved term, case-folded and of any length; null and empty terms reserve nothing.

    Prompts are judged by their text: rows without a key or with a repeated one are told apart, null texts stay.
    """
    reserved = terms.select(F.col(term).alias("phrase"), F.lower(term).alias("id"))
    hits = literal_hits(prompts.select(text).distinct(), [text], text, reserved, min_len=1)
    return prompts.join(hits.select(text).distinct(), text, "left_anti").select(*prompts.columns)


def hold_out(runs: DataFrame, reserved: DataFrame, key: str, text: str = "output", min_chars: int = 800) -> DataFrame:
    """Runs outside the reserved cases whose base text is long enough."""
    return runs.where(F.length(text) >= min_chars).join(reserved, key, "left_anti")


def call_cost(calls: DataFrame, rate_in: str = "5.00", rate_cached: str = "0.50", rate_out: str = "25.00") -> DataFrame:
    """USD per call from token counts at rates per million tokens, as DECIMAL(18,8)."""
    def part(n, rate):
        return (n.cast("decimal(20,0)") * F.lit(rate).cast("decimal(10,2)") / F.lit("1000000").cast("decimal(10,0)")).cast("decimal(18,8)")
    fresh = F.col("input_tokens") - F.col("cached_input_tokens")
    return calls.withColumn("cost", (
        part(fresh, rate_in) + part(F.col("cached_input_tokens"), rate_cached) + part(F.col("output_tokens"), rate_out)
    ).cast("decimal(18,8)"))


def integrity_duplicates(runs: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Texts that occur more than once inside a (mode, case) cell, by hash of the normalised text."""
    return runs.groupBy(*by, F.md5(X.norm(text, "space")).alias("digest")).agg(F.count("*").alias("copies")).where("copies > 1")


def integrity_coverage(runs: DataFrame, arm: str, case: str, text: str, short: int = 50) -> DataFrame:
    """Runs, near-empty runs and cases covered per arm."""
    return runs.groupBy(arm).agg(
        F.count("*").alias("runs"), F.count_if(F.length(text) < short).alias("short_runs"),
        F.count_distinct(case).alias("cases"))


def composition(runs: DataFrame, key: str, backends: str, default: str = "ollama") -> DataFrame:
    """Which backend served which phases: uniform, default or swapped, with the phases per backend."""
    entries = F.map_entries(backends)
    swapped = F.filter(entries, lambda e: (e["value"] != default) & (e["value"] != ""))
    tags = F.array_distinct(F.transform(swapped, lambda e: e["value"]))
    label = F.transform(tags, lambda t: F.concat(t, F.lit(": "), F.array_join(F.array_sort(F.transform(
        F.filter(swapped, lambda e: e["value"] == t), lambda e: e["key"])), ", ")))
    return runs.select(
        key,
        F.when(F.size(entries) == 0, "none").when(F.size(swapped) == 0, "default")
        .when((F.size(swapped) == F.size(entries)) & (F.size(tags) == 1), "uniform").otherwise("swapped").alias("kind"),
        F.array_join(F.array_sort(label), " / ").alias("label"))
