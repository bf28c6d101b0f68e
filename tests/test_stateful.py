"""Lifecycle and delta assembly with timers against their batch twins, and state that goes away."""

from datetime import datetime, timedelta

import pytest

from ledgerloom import schemas
from ledgerloom.streaming import feed as S
from ledgerloom.streaming import lifecycle as Y
from ledgerloom.streaming import stateful as W

T0 = datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield W.use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def files(spark, rows, path, parts):
    """One file per part, read in the order of their numbers."""
    df = spark.createDataFrame(rows, schemas.RUN_EVENTS)
    for p, keep in enumerate(parts):
        df.where(keep).coalesce(1).write.parquet(f"{path}/b{p}")
    return spark.readStream.schema(schemas.RUN_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*"), df


def event(run, minute, kind, mode="m", seq=0, delta=None, phase="p"):
    return (run, T0 + timedelta(minutes=minute), kind, mode, "s", None, phase, delta, seq)


def keys_in_state(spark, checkpoint, name, key="run_id"):
    state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return {r[0] for r in state.select(f"key.{key}").distinct().collect()}


def test_lifecycle_with_timers_equals_the_batch_and_forgets(rocks, tmp_path):
    kinds = ["queued", "start", "mode_done", "mode_failed", "mode_refused", "end"]
    rows = [event(f"r{i % 9}", i // 3, kinds[(i * 5 + i // 9) % 6], seq=i) for i in range(120)]
    # a row far ahead moves the watermark past every timer
    rows += [event("clock", 60 * 24 * 5, "start", seq=1000), event("clock", 60 * 24 * 5 + 1, "start", seq=1001)]
    live, batch = files(rocks, rows, str(tmp_path / "in"), ["seq < 60", "seq >= 60 and seq < 1000", "seq = 1000", "seq = 1001"])
    out = S.run_available(W.lifecycle_state(live), "tws_life", mode="update", checkpoint=str(tmp_path / "ck")).collect()
    want = {r.run_id: (r.status, r.modes_completed, r.modes_failed, r.modes_refused, r.last_ts) for r in Y.lifecycle(batch).collect()}
    running = {r.run_id: (r.status, r.modes_completed, r.modes_failed, r.modes_refused, r.last_ts) for r in sorted(
        (r for r in out if not r.settled), key=lambda r: (r.modes_completed + r.modes_failed + r.modes_refused, r.last_ts))}
    assert running == want
    settled = {r.run_id: r for r in out if r.settled}
    assert set(settled) == set(want) - {"clock"}
    for run, r in settled.items():
        assert r.status == ("completed" if want[run][1] else "failed")
    assert keys_in_state(rocks, str(tmp_path / "ck"), "run") == {"clock"}


def test_deltas_wait_for_their_end_and_come_in_order(rocks, tmp_path):
    rows = [event(f"r{i % 4}", i // 4, "token", seq=i, delta=f"<{i}>") for i in range(48)]
    rows += [event(f"r{k}", 12, "end", seq=100 + k) for k in range(3)]
    rows += [event("clock", 60 * 24 * 5, "end", seq=1000), event("clock", 60 * 24 * 5 + 1, "end", seq=1001)]
    # odd deltas arrive a file late, behind the end markers
    parts = ["seq < 48 and seq % 2 = 0", "seq between 100 and 103", "seq < 48 and seq % 2 = 1", "seq = 1000", "seq = 1001"]
    live, batch = files(rocks, rows, str(tmp_path / "in"), parts)
    got = {(r.run_id, r.mode, r.phase): r for r in S.run_available(W.assemble_stream(live), "tws_text", checkpoint=str(tmp_path / "ck")).collect()}
    want = {(r.run_id, r.mode, r.phase): (r.text, r.deltas) for r in S.assemble_deltas(batch).collect()}
    assert {k: (r.text, r.deltas) for k, r in got.items()} == want and len(want) == 4
    assert {k[0]: r.complete for k, r in got.items()} == {"r0": True, "r1": True, "r2": True, "r3": False}
    assert keys_in_state(rocks, str(tmp_path / "ck"), "seen") == {"clock"}
