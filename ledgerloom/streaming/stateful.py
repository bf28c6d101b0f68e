"""Lifecycle and delta assembly on transformWithStateInPandas: value and list state, event-time timers.

The session needs the RocksDB state store (`use_rocksdb`); the state-per-group forms in `lifecycle` need none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


#: How long after its last event a run without an end marker is given up.
ABANDONED = 24 * 3600 * 1000
RUN_STATE = "started boolean, ended boolean, completed int, failed int, refused int, last_ms long"
RUN_ROWS = "run_id string, status string, modes_completed int, modes_failed int, modes_refused int, last_ts timestamp, settled boolean"
RUN_COLUMNS = ["run_id", "status", "modes_completed", "modes_failed", "modes_refused", "last_ts", "settled"]
KINDS = ("mode_done", "mode_failed", "mode_refused")


def status_of(started: bool, ended: bool, completed: int) -> str:
    if ended:
        return "completed" if completed else "failed"
    return "running" if started else "pending"


class Lifecycle(StatefulProcessor):
    """Counters per run and one timer: a day after the last event, or at once behind an end marker's grace.

    Emits the run's current row when it changes, and a last one with `settled` when its state goes.
    """

    def __init__(self, grace_ms: int):
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE)

    def row(self, key, state, settled: bool) -> pd.DataFrame:
        started, ended, done, failed, refused, last = state
        status = status_of(started, ended or settled, done)
        return pd.DataFrame([(key[0], status, done, failed, refused, pd.Timestamp(last, unit="ms"), settled)], columns=RUN_COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started, ended, done, failed, refused, last = self.run.get() if self.run.exists() else (False, False, 0, 0, 0, 0)
        for f in rows:
            kinds = f["type"]
            started, ended = started or bool((kinds != "queued").any()), ended or bool((kinds == "end").any())
            done, failed, refused = (n + int((kinds == k).sum()) for n, k in zip((done, failed, refused), KINDS))
            last = max(last, int(f["ts"].max().timestamp() * 1000))
        state = (started, ended, done, failed, refused, last)
        self.run.update(state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + (self.grace if ended else ABANDONED))
        yield self.row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            state = self.run.get()
            self.run.clear()
            yield self.row(key, state, True)

    def close(self) -> None:
        pass


def lifecycle_state(events: DataFrame, delay: str = "2 hours", grace_ms: int = 3600 * 1000) -> DataFrame:
    """Run status as it changes. Ended runs wait `grace_ms` of event time for stragglers, others a day; then state goes."""
    src = events.select("run_id", "ts", "type").where("run_id is not null and ts is not null").withWatermark("ts", delay)
    return src.groupBy("run_id").transformWithStateInPandas(
        Lifecycle(grace_ms), RUN_ROWS, "Update", "EventTime")


TEXT_KEYS = ("run_id", "mode", "phase")
TEXT_ROWS = "run_id string, mode string, phase string, text string, deltas int, complete boolean"
TEXT_COLUMNS = [*TEXT_KEYS, "text", "deltas", "complete"]


class Deltas(StatefulProcessor):
    """Token deltas in list state until their text ends; flushed in sequence order.

    The end marker's `seq` is the number of the last event. Deltas may overtake it, so a marked text waits `grace_ms`
    of event time for stragglers, an unmarked one a day, and is then given up with `complete` false.
    """

    def __init__(self, grace_ms: int):
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq long, delta string")
        self.seen = handle.getValueState("seen", "last_ms long, marked boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, marked = self.seen.get() if self.seen.exists() else (0, False)
        for f in rows:
            marked = marked or bool((f["type"] == "end").any())
            last = max(last, int(f["ts"].max().timestamp() * 1000))
            tokens = f[f["type"] == "token"]
            if len(tokens):
                self.parts.appendList([(int(s), d) for s, d in zip(tokens["seq"], tokens["delta"])])
        self.seen.update((last, marked))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + (self.grace if marked else ABANDONED))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        marked = self.seen.exists() and self.seen.get()[1]
        parts = sorted(self.parts.get(), key=lambda p: p[0]) if self.parts.exists() else []
        self.parts.clear()
        self.seen.clear()
        if parts:
            text = "".join(d or "" for _, d in parts)
            yield pd.DataFrame([(*key, text, len(parts), marked)], columns=TEXT_COLUMNS)

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, delay: str = "2 hours", grace_ms: int = 60 * 1000) -> DataFrame:
    """Texts from token deltas, one row each once event time has passed their end. One group is one generated text."""
    src = events.where(F.col("type").isin("token", "end")).select(*TEXT_KEYS, "ts", "type", "seq", "delta")
    src = src.where("ts is not null").withWatermark("ts", delay)
    return src.groupBy(*TEXT_KEYS).transformWithStateInPandas(
        Deltas(grace_ms), TEXT_ROWS, "Append", "EventTime")
