"""Sinks written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions.cuts import shared_dir
from ledgerloom.plans.catalog import query
from ledgerloom.sources import ledger as L
from ledgerloom.sources import sinks as S


def written(df, name, **options):
    """Committed to a new sink of the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    S.commit(df, path, "0001", **options)
    return S.read_committed(df.sparkSession, path)


@query("s12_envelopes", """WITH r AS (SELECT doc_id // 7 AS case_id, lang, doc_id, n_chars, text, row_number() OVER (PARTITION BY doc_id // 7, lang ORDER BY doc_id DESC) AS rn FROM documents)
  SELECT case_id, lang AS mode, case_id || '__' || lang || '.json' AS file, doc_id, n_chars, md5(text) AS text FROM r WHERE rn = 1""")
def s12_envelopes(t):
    """Newest run per (case, mode), written as JSON lines by mode, committed, read back and decoded."""
    d = t.read("documents").select(F.floor(F.col("doc_id") / 7).alias("case_id"), F.col("lang").alias("mode"), "doc_id", "n_chars", "text")
    back = written(S.envelopes(d, "case_id", "mode", ["doc_id"], ["doc_id", "n_chars", "text"]), "envelopes", partition=["mode"], fmt="json", compression="gzip")
    body = F.from_json("body", "doc_id long, n_chars long, text string")
    return back.select("case_id", "mode", "file", body.alias("b")).select(
        "case_id", "mode", "file", "b.doc_id", "b.n_chars", F.md5("b.text").alias("text"))


_STATUS = "CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'refused' ELSE 'completed' END"
_PAIRS = "coalesce(string_agg(mode || '=' || reason, ',' ORDER BY mode) FILTER (status = '{0}'), '')"


def attempts(t):
    """Attempts of modes bound to the event table: a run is a user's day, what an event cost its value in cents."""
    return t.read("events").select(
        F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("run_id"), F.col("event_type").alias("mode"), "ts",
        F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 7 == 0, "refused").otherwise("completed").alias("status"),
        F.concat(F.lit("stage "), F.floor(F.col("value") / 50).cast("string")).alias("reason"),
        F.round(F.col("value") / 100, 8).cast("decimal(18,8)").alias("cost"), F.floor(F.col("value") * 10).alias("latency_ms"), F.col("props").alias("output"))


ATTEMPTS = f"""a AS (SELECT user_id || '-' || ts::DATE::VARCHAR AS run_id, event_type AS mode, ts, {_STATUS} AS status, 'stage ' || floor(value / 50)::BIGINT AS reason,
    round(value / 100, 8)::DECIMAL(18,8) AS cost, floor(value * 10)::BIGINT AS latency_ms, props AS output FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY run_id, mode ORDER BY ts DESC, status DESC, reason DESC) AS rn FROM a),
  s AS (SELECT run_id, string_agg(mode, ',' ORDER BY mode) AS requested, coalesce(string_agg(mode, ',' ORDER BY mode) FILTER (status = 'completed'), '') AS completed,
    {_PAIRS.format('refused')} AS refused, {_PAIRS.format('failed')} AS failed FROM n WHERE rn = 1 GROUP BY 1),
  c AS (SELECT run_id, sum(cost) AS spent, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM a GROUP BY 1)"""


def _pairs(col):
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("s12_run_summary", f"""WITH {ATTEMPTS} SELECT run_id, requested, completed, refused, failed, round(spent, 4)::DOUBLE AS spent, last_at FROM s JOIN c USING (run_id)""")
def s12_run_summary(t):
    """Run summaries, committed as Parquet and read back."""
    s = written(S.run_summary(attempts(t), cap=F.lit("1.00").cast("decimal(18,8)")), "summaries")
    return s.select("run_id", F.array_join("modes_requested", ",").alias("requested"), F.array_join("modes_completed", ",").alias("completed"),
                    _pairs("modes_refused").alias("refused"), _pairs("modes_failed").alias("failed"),
                    F.round("spent", 4).cast("double").alias("spent"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("s12_report_payload", f"""WITH {ATTEMPTS}, o AS (SELECT run_id, mode, length(output) AS chars, latency_ms, output,
    row_number() OVER (PARTITION BY run_id, mode ORDER BY length(output) DESC, latency_ms DESC, output DESC) AS k FROM a)
  SELECT run_id, any_value(completed) AS completed, string_agg(mode || ':' || chars || ':' || latency_ms || ':' || output, ';' ORDER BY mode) AS outputs FROM o JOIN s USING (run_id) WHERE k = 1 GROUP BY 1""")
def s12_report_payload(t):
    """Report documents per run, committed as JSON lines, read back and decoded."""
    a = attempts(t)
    p = written(S.report_payload(S.run_summary(a), a), "reports", fmt="json", compression="gzip")
    b = F.from_json("payload", "modes_completed array<string>, outputs array<struct<mode:string,chars:long,latency_ms:long,excerpt:string>>")
    return p.select("run_id", b.alias("b")).select("run_id", F.array_join("b.modes_completed", ",").alias("completed"), F.array_join(F.transform(
        "b.outputs", lambda e: F.concat_ws(":", e["mode"], e["chars"].cast("string"), e["latency_ms"].cast("string"), e["excerpt"])), ";").alias("outputs"))


@query("s11_read_items", """SELECT source AS cell, doc_id AS id, lang, md5(text) AS text FROM documents""")
def s11_read_items(t):
    """Dimension files of one items array each, here a thousand documents a file, through the item reader."""
    d = t.read("documents")
    files = d.groupBy((F.col("doc_id") / 1000).cast("long").alias("file")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.col("source").alias("cell"), F.col("doc_id").alias("id"), "lang", "text")).alias("items"))).alias("value"))
    path = f"{shared_dir(t.spark)}/ledgerloom-items-{uuid.uuid4().hex}"
    files.write.partitionBy("file").option("compression", "gzip").text(path)
    items = L.read_items(t.spark, f"{path}/file=*", "items array<struct<cell:string,id:long,lang:string,text:string>>")
    return items.select("cell", "id", "lang", F.md5("text").alias("text"))
