"""Batch twins of the streaming operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import hygiene as P
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded
from ledgerloom.plans.hygiene import CALLS, calls
from ledgerloom.streaming import feed as S
from ledgerloom.streaming import late as Z
from ledgerloom.streaming import lifecycle as L

KINDS = {"signup": "start", "click": "mode_done", "error": "mode_failed", "view": "token", "purchase": "mode_refused"}
_map = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"


def events(t):
    """Run events bound to the event table; every fifth event id closes its run's day."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    return t.read("events").select(
        F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("run_id"), F.date_trunc("hour", "ts").alias("ts"),
        F.when(F.col("event_id") % 5 == 0, "end").otherwise(kind).alias("type"), F.col("event_type").alias("mode"),
        (F.floor(F.col("value") / 50)).cast("string").alias("stage"), F.lit("p").alias("phase"), F.col("props").alias("delta"), F.col("event_id").alias("seq"))


EV = f"""ev AS MATERIALIZED (SELECT user_id || '-' || ts::DATE::VARCHAR AS run_id, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 5 = 0 THEN 'end' ELSE {_map} END AS type, event_type AS mode,
   floor(value / 50)::BIGINT::VARCHAR AS stage, props AS delta, event_id AS seq FROM events)"""


@query("r1_event_feed", f"""WITH {EV}, d AS (SELECT DISTINCT run_id, ts, type, stage, mode FROM ev WHERE type <> 'token' UNION ALL SELECT run_id, ts, type, stage, mode FROM ev WHERE type = 'token')
  SELECT run_id, count(*) AS n, count(*) FILTER (type = 'token') AS tokens FROM d GROUP BY 1""")
def r1_event_feed(t):
    f = S.event_feed(events(t))
    return f.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "token").alias("tokens"))


@query("r2_lifecycle", f"""WITH {EV}, g AS (SELECT run_id, bool_or(type <> 'queued') AS s, bool_or(type = 'end') AS e, count(*) FILTER (type = 'mode_done') AS d, count(*) FILTER (type = 'mode_failed') AS f, count(*) FILTER (type = 'mode_refused') AS r FROM ev GROUP BY 1)
  SELECT run_id, CASE WHEN e AND d > 0 THEN 'completed' WHEN e THEN 'failed' WHEN s THEN 'running' ELSE 'pending' END AS status, d::INT AS modes_completed, f::INT AS modes_failed, r::INT AS modes_refused FROM g""")
def r2_lifecycle(t):
    return L.lifecycle(events(t)).drop("last_ts")


@query("r3_assemble_deltas", f"WITH {EV} SELECT run_id, mode, md5(string_agg(delta, '' ORDER BY seq)) AS text, count(*)::INT AS deltas FROM ev WHERE type = 'token' GROUP BY 1, 2")
def r3_assemble_deltas(t):
    return S.assemble_deltas(events(t)).select("run_id", "mode", F.md5("text").alias("text"), "deltas")


@query("r4_newest_history", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def r4_newest_history(t):
    return S.newest_history(t.read("events").select("event_id", "user_id", "event_type", "ts"), ["ts", "event_id"]).drop("ts")


@query("r5_budget_guard", f"""WITH RECURSIVE {CALLS.replace('cl AS MATERIALIZED', 'cl AS').replace('cost AS MATERIALIZED', 'cost AS')}, o AS (SELECT ledger_id, cost, row_number() OVER (PARTITION BY ledger_id ORDER BY seq) AS k FROM cost),
  w AS (SELECT ledger_id, k, cost <= 0.4::DECIMAL(18,8) AS ok, CASE WHEN cost <= 0.4::DECIMAL(18,8) THEN cost ELSE 0::DECIMAL(18,8) END AS spent FROM o WHERE k = 1
    UNION ALL SELECT o.ledger_id, o.k, w.spent + o.cost <= 0.4::DECIMAL(18,8), CASE WHEN w.spent + o.cost <= 0.4::DECIMAL(18,8) THEN (w.spent + o.cost)::DECIMAL(18,8) ELSE w.spent END FROM w JOIN o ON o.ledger_id = w.ledger_id AND o.k = w.k + 1)
  SELECT ledger_id, count(*) AS calls, count(*) FILTER (ok) AS accepted, round(max(spent), 4)::DOUBLE AS spent FROM w GROUP BY 1""")
def r5_budget_guard(t):
    """Ordered refusals per ledger under a cap of 0.40."""
    g = L.budget_guard(P.call_cost(calls(t)), "0.40")
    return L.spend_summary(g).withColumn("spent", F.round("spent", 4).cast("double"))


@query("r5_one_ledger", """WITH o AS (SELECT l_orderkey * 8 + l_linenumber AS seq, (l_extendedprice / 100000)::DECIMAL(18,8) AS c FROM lineitem),
  l AS (SELECT list({'c': c, 's': seq::HUGEINT, 'n': 1} ORDER BY seq, c) AS costs, count(*) AS calls FROM o),
  w AS (SELECT calls, list_reduce(list_concat([{'c': 0::DECIMAL(18,8), 's': 0::HUGEINT, 'n': 0}], costs), lambda a, x: CASE WHEN a.c + x.c <= 5000 THEN
     {'c': (a.c + x.c)::DECIMAL(18,8), 's': a.s + x.s, 'n': a.n + 1} ELSE a END) AS r FROM l)
  SELECT calls, r.n::BIGINT AS accepted, r.s::BIGINT AS seqs, round(r.c, 4)::DOUBLE AS spent FROM w""")
def r5_one_ledger(t):
    """One ledger of all line items under a cap, decided in many tasks."""
    c = t.read("lineitem").select(F.lit("all").alias("ledger_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
                                  F.round(F.col("l_extendedprice") / 100000, 8).cast("decimal(18,8)").alias("cost"))
    g = L.budget_guard(c, "5000")
    return g.agg(F.count("*").alias("calls"), F.count_if("accepted").alias("accepted"), F.sum(F.when(F.col("accepted"), F.col("seq"))).alias("seqs"),
                 F.round(F.max("spent"), 4).cast("double").alias("spent"))


@query("r6_live_rate", f"""WITH {K.DEALT}, {K.audited('prose')}, r AS (SELECT a.*, TIMESTAMP '2024-01-01' + to_minutes(run_id * 7) AS ts, contains(alpha, 'und') OR alpha || beta || gamma = '' AS q FROM aud a JOIN runs USING (run_id))
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS runs, count(*) FILTER (n_inv > 0) AS inventing, round(count(*) FILTER (n_inv > 0) / count(*)::DOUBLE, 6) AS rate FROM r WHERE NOT q AND NOT floored GROUP BY 1""")
def r6_live_rate(t):
    """Arriving runs audited, quarantined and rated per hour."""
    d = t.dealt.select(
        "run_id", "condition", "writer_id", "prompt_id", "output", F.array("alpha", "beta", "gamma").alias("upstream"), F.col("alpha").alias("writer_prompt"),
        F.filter(F.array("alpha", "beta", "gamma"), lambda x: x != "").alias("routes"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("run_id") * 420).alias("ts"))
    r = S.live_rate(S.route_live(d, "prose", forbid="und"))
    return rounded(r.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")))


_ARRIVED = "(event_id + user_id * 37 % 500) // 100"


@query("r6_late_rows", f"""WITH e AS (SELECT *, {_ARRIVED} AS batch FROM events), t AS (SELECT batch, max(ts) AS top FROM e GROUP BY 1),
  m AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM t)
  SELECT event_id, batch, coalesce(ts < mark - INTERVAL 12 HOUR, false) AS late FROM e JOIN m USING (batch)""")
def r6_late_rows(t):
    """Events arriving out of order in batches, judged against the mark of the batches before."""
    e = t.read("events").select("event_id", "ts", F.expr("(event_id + user_id * 37 % 500) div 100").alias("batch"))
    return Z.split_batches(e, "batch", delay="12 hours").drop("ts")


@query("r6_settled_rate", f"""WITH {K.DEALT}, {K.audited('prose')}, r AS (SELECT a.*, TIMESTAMP '2024-01-01' + to_minutes(run_id * 7) AS ts, (run_id + (run_id * 53) % 120) // 20 AS batch FROM aud a JOIN runs USING (run_id)),
  t AS (SELECT batch, max(ts) AS top FROM r GROUP BY 1), m AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM t)
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS runs, count(*) FILTER (n_inv > 0) AS inventing, round(count(*) FILTER (n_inv > 0) / count(*)::DOUBLE, 6) AS rate,
    count(*) FILTER (ts < mark - INTERVAL 2 HOUR) AS late_runs FROM r JOIN m USING (batch) WHERE NOT floored GROUP BY 1""")
def r6_settled_rate(t):
    """Hourly invention rates with late runs counted back into their hours."""
    d = t.runs.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("run_id") * 420)).withColumns(
        {"writer_prompt": F.lit("given"), "routes": F.array(F.lit("a")), "batch": F.expr("(run_id + (run_id * 53) % 120) div 20")})
    r = Z.split_batches(S.route_live(d, "prose").withColumn("quarantined", F.lit(False)), "batch", delay="2 hours")
    s = Z.settled_rate(r.where("not late").drop("late"), r.where("late").drop("late"))
    return rounded(s.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")))
