"""Run lifecycle and budget guard: a batch twin each, and a stateful streaming form."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.streaming.budget import budget_guard

__all__ = ["budget_guard", "budget_stream", "lifecycle", "lifecycle_stream", "spend_summary"]

# ---------------------------------------------------------------- lifecycle

LIFECYCLE = "run_id string, status string, modes_completed int, modes_failed int, modes_refused int, last_ts timestamp"
_STATE = "started boolean, ended boolean, completed int, failed int, refused int, last_ts timestamp"


def lifecycle(events: DataFrame) -> DataFrame:
    """Status per run: pending, running, then completed if any mode finished, else failed, once the end came.

    events  run_id, ts, type (start, mode_done, mode_failed, mode_refused, end, ...), mode
    """
    kind = F.col("type")
    g = events.groupBy("run_id").agg(
        F.bool_or(kind != "queued").alias("_s"), F.bool_or(kind == "end").alias("_e"),
        F.count_if(kind == "mode_done").alias("modes_completed"), F.count_if(kind == "mode_failed").alias("modes_failed"),
        F.count_if(kind == "mode_refused").alias("modes_refused"), F.max("ts").alias("last_ts"))
    status = (F.when(F.col("_e") & (F.col("modes_completed") > 0), "completed").when(F.col("_e"), "failed")
              .when(F.col("_s"), "running").otherwise("pending"))
    return g.select("run_id", status.alias("status"), *[F.col(c).cast("int").alias(c) for c in (
        "modes_completed", "modes_failed", "modes_refused")], "last_ts")


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    started, ended, done, failed, refused, last = state.get if state.exists else (False, False, 0, 0, 0, None)
    if state.hasTimedOut:
        state.remove()
        status = "completed" if done else "failed"
        yield pd.DataFrame([(key[0], status, done, failed, refused, last)], columns=LIFECYCLE_COLUMNS)
        return
    for f in frames:
        kinds = f["type"]
        started, ended = started or bool((kinds != "queued").any()), ended or bool((kinds == "end").any())
        done, failed = done + int((kinds == "mode_done").sum()), failed + int((kinds == "mode_failed").sum())
        refused += int((kinds == "mode_refused").sum())
        top = f["ts"].max()
        last = top if last is None or top > last else last
    status = ("completed" if done else "failed") if ended else ("running" if started else "pending")
    state.update((started, ended, done, failed, refused, last.to_pydatetime() if hasattr(last, "to_pydatetime") else last))
    state.setTimeoutTimestamp(int(pd.Timestamp(last).timestamp() * 1000) + ABANDONED_MS)
    yield pd.DataFrame([(key[0], status, done, failed, refused, last)], columns=LIFECYCLE_COLUMNS)


ABANDONED_MS = 24 * 3600 * 1000
LIFECYCLE_COLUMNS = ["run_id", "status", "modes_completed", "modes_failed", "modes_refused", "last_ts"]


def lifecycle_stream(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """The same as state per run: counters only, dropped once event time is a day past the run's last event
    (such runs count as ended).

    Emits the run's current row whenever it changes.
    """
    return events.select("run_id", "ts", "type").withWatermark("ts", delay).groupBy("run_id").applyInPandasWithState(
        _advance, LIFECYCLE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- budget guard

BUDGET = "ledger_id string, seq long, cost decimal(18,8), accepted boolean, spent decimal(18,8)"
BUDGET_COLUMNS = ["ledger_id", "seq", "cost", "accepted", "spent"]


def _decide(spent: Decimal, costs, cap: Decimal):
    out = []
    for cost in costs:
        ok = spent + cost <= cap
        spent = spent + cost if ok else spent
        out.append((ok, spent))
    return spent, out


def budget_stream(calls: DataFrame, cap: str) -> DataFrame:
    """`budget_guard` as state per ledger: the running total, over calls in sequence order within each micro-batch."""
    limit = Decimal(cap)

    def guard(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else Decimal(0)
        rows = pd.concat(list(frames)).sort_values("seq")
        spent, decided = _decide(spent, rows["cost"], limit)
        state.update((spent,))
        yield rows.assign(accepted=[d for d, _ in decided], spent=[s for _, s in decided])[BUDGET_COLUMNS]

    src = calls.select("ledger_id", "seq", F.col("cost").cast("decimal(18,8)").alias("cost"))
    return src.groupBy("ledger_id").applyInPandasWithState(guard, BUDGET, "spent decimal(18,8)", "append", GroupStateTimeout.NoTimeout)


def spend_summary(decided: DataFrame) -> DataFrame:
    return decided.groupBy("ledger_id").agg(
        F.count("*").alias("calls"), F.count_if("accepted").alias("accepted"), F.max("spent").alias("spent"))

