"""Readers and sinks on files, and streams against their batch twins."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.sources import ledger as L
from ledgerloom.streaming import feed as S
from ledgerloom.streaming import lifecycle as Y


def envelope(**kw):
    base = {"schema_version": 2, "source": "bench", "case_id": "case_1", "mode": "panel", "model": "m", "final_output": "final" ,
            "execution_path": {"quarantined": False, "routes": ["gate"]},
            "deliberation": {"plan": {"routes": ["legal"]}, "turns": [{"seat": "legal", "output_text": "said"}, {"seat": "x", "output_text": " "}],
                             "synthesis": {"input_messages": [{"role": "system", "content": "be brief"}]}}}
    return {**base, **kw}


def test_read_ledger(spark, tmp_path):
    files = {
        "ok": envelope(final_output="text\n\n---\nProvenance note: x"), "draft": envelope(pre_gate_output="draft"),
        "v1": {k: v for k, v in envelope(schema_version=1).items() if k != "deliberation"},
        "empty": envelope(deliberation={}), "zero": envelope(deliberation={"plan": {"routes": []}, "turns": [{"output_text": "t"}]}),
        "noroutes": envelope(deliberation={"plan": {"routes": None}, "turns": [{"output_text": "t"}]}),
        "bad": envelope(execution_path={"quarantined": True}),
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{not json")
    got = {r.run_id: r for r in L.read_ledger(spark, str(tmp_path)).collect()}
    assert set(got) == {"ok", "draft", "noroutes"}
    assert got["ok"].output == "text" and got["draft"].output == "draft" and got["ok"].upstream == ["said"]
    assert got["ok"].writer_prompt == "be brief" and got["ok"].routes == ["legal"] and got["noroutes"].routes == ["gate"]
    shipped = {r.run_id: r.output for r in L.read_ledger(spark, str(tmp_path), variant=L.AS_SHIPPED).collect()}
    assert shipped["draft"] == "final"
    assert L.read_ledger(spark, str(tmp_path), require_upstream=False).count() == 5
    assert L.read_ledger(spark, str(tmp_path), modes=["other"]).count() == 0


def test_read_run_log_and_sinks(spark, tmp_path):
    log = tmp_path / "runs.jsonl"
    log.write_text("\n".join(json.dumps(r) for r in [
        {"id": "a", "up": ["x", "", "y"], "msgs": ["first", "last"], "c": "k"}, {"id": None, "up": [], "msgs": [], "c": None}]))
    runs = L.read_run_log(spark, str(log), L.FieldMap(upstream="up", output="msgs.-1", run_id="id", condition="c"))
    got = {r.output: r for r in runs.collect()}
    assert got["last"].upstream == ["x", "y"] and got["last"].run_id == "a" and len(got[""].run_id) == 64
    L.write_runs(runs.where("condition <> ''"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("condition = 'k'").count() == 1
    L.write_pairs(runs.select("run_id"), str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs")).count() == 2
    (tmp_path / "items.json").write_text(json.dumps({"items": [{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]}))
    assert L.read_items(spark, str(tmp_path / "items.json"), "items array<struct<id:int,q:string>>").count() == 2


def test_labels_follow_global_offsets(spark):
    units = spark.createDataFrame([(i, [f"{i}.{j}" for j in range(i % 4)]) for i in range(2000)], "unit_id long, sentences array<string>")
    flat = [(u, j) for u in range(2000) for j in range(u % 4)]
    batches = [("j", s, {str(k + 1): {"f": (s + k) % 3 == 0} for k in range(min(10, len(flat) - s))}) for s in range(0, len(flat), 10)]
    cache = spark.createDataFrame(batches, "judge string, start long, labels map<string,map<string,boolean>>")
    got = {(r.unit_id, r.sent_idx): r.value for r in L.labels_long(units, cache).collect()}
    assert got == {p: g % 3 == 0 for g, p in enumerate(flat)}


T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def event_rows():
    kinds = ["queued", "start", "token", "mode_done", "mode_failed", "token", "mode_refused", "end"]
    rows = []
    for i in range(160):
        run = f"r{i % 12}"
        rows.append((run, T0 + timedelta(seconds=30 * (i // 2)), kinds[(i * 5 + i // 12) % 8], "m", "s", None, "p", f"d{i}", i))
    return rows


def stream(spark, rows, schema, path, parts=4):
    df = spark.createDataFrame(rows, schema)
    for p in range(parts):
        df.where(F.col("seq") % parts == p).coalesce(1).write.parquet(f"{path}/b{p}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*"), df


def test_event_feed_stream_equals_batch(spark, tmp_path, event_rows):
    live, batch = stream(spark, event_rows, schemas.RUN_EVENTS, str(tmp_path / "in"))
    got = S.run_available(S.event_feed(live, delay="2 hours"), "feed", checkpoint=str(tmp_path / "ck"))
    cols = ["run_id", "ts", "type", "stage", "mode"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, S.event_feed(batch).select(cols).collect()))


def test_lifecycle_stream_equals_batch(spark, tmp_path, event_rows):
    live, batch = stream(spark, event_rows, schemas.RUN_EVENTS, str(tmp_path / "in"))
    out = S.run_available(Y.lifecycle_stream(live), "life", mode="update", checkpoint=str(tmp_path / "ck"))
    key = F.struct((F.col("modes_completed") + F.col("modes_failed") + F.col("modes_refused")).alias("n"), (F.col("status") != "pending").alias("s"),
                   F.col("status").isin("completed", "failed").alias("e"), "last_ts", (F.col("status") == "completed").alias("c"))
    last = out.groupBy("run_id").agg(F.max_by(F.struct("status", "modes_completed", "modes_failed", "modes_refused"), key).alias("r")).select("run_id", "r.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, Y.lifecycle(batch).drop("last_ts").collect()))


def test_budget_guard_stream_equals_batch(spark, tmp_path):
    calls = [(f"l{i % 3}", i, Decimal((i * 37) % 11 + 1)) for i in range(60)]
    schema = "ledger_id string, seq long, cost decimal(18,8)"
    # one file per span of the sequence, so micro-batches arrive in call order
    df = spark.createDataFrame(calls, schema)
    for p in range(3):
        df.where(F.col("seq").between(20 * p, 20 * p + 19)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{p}"))
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "b*"))
    got = S.run_available(Y.budget_stream(live, "40"), "spend", checkpoint=str(tmp_path / "ck"))
    batch = Y.budget_guard(df, "40")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    spent, want = {}, {}
    for ledger, seq, cost in calls:
        ok = spent.get(ledger, 0) + cost <= 40
        spent[ledger] = spent.get(ledger, 0) + (cost if ok else 0)
        want[seq] = ok
    assert {r.seq: r.accepted for r in batch.collect()} == want


def test_history_and_routing_sinks(spark, tmp_path):
    text = "We assume steady demand. " + "Plain words follow here in order to fill the page. " * 12
    rows = [(f"r{i}", "p", "c", "w", ["verify current rates"], text if i % 2 else "x" * 600, "use markers" if i % 3 else "none", ["a"], T0 + timedelta(minutes=7 * i), i)
            for i in range(40)]
    schema = ("run_id string, prompt_id string, condition string, writer_id string, upstream array<string>, output string, "
              "writer_prompt string, routes array<string>, ts timestamp, seq long")
    live, batch = stream(spark, rows, schema, str(tmp_path / "in"))
    routed = S.route_live(live, "epistemic", require="markers")
    S.write_routed(routed, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "ck1")).awaitTermination()
    ok, bad = spark.read.parquet(str(tmp_path / "ok")), spark.read.parquet(str(tmp_path / "bad"))
    assert ok.count() + bad.count() == 40 and bad.count() == 14
    rates = S.live_rate(S.route_live(batch, "epistemic", require="markers")).collect()
    assert sum(r.runs for r in rates) == 26
    S.keep_history(live.select("run_id", "ts"), str(tmp_path / "hist"), ["ts", "run_id"], str(tmp_path / "ck2"), n=5).awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "hist").iterdir() if p.name.startswith("epoch="))
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / f"hist/epoch={last}")).collect()) == [f"r{i}" for i in range(35, 40)]
