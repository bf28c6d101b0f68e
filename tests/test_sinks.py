"""Committed sinks: what readers see before, during and after commits, and what the rows hold."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import sinks as S

T0 = datetime(2026, 1, 1)


def test_a_version_is_written_once_and_read_whole(spark, tmp_path):
    path = str(tmp_path / "sink")
    with pytest.raises(FileNotFoundError):
        S.read_committed(spark, path)
    first = spark.range(100).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("string"))
    m = S.commit(first, path, "0001", partition=["k"])
    assert m["rows"] == 100 and m["bytes"] > 0 and S.versions(spark, path) == ["0001"]
    # a retry of the same version, with other rows, changes nothing
    assert S.commit(first.limit(5), path, "0001", partition=["k"]) == m
    assert S.read_committed(spark, path).columns == ["id", "k"]
    assert sorted(map(tuple, S.read_committed(spark, path).collect())) == sorted(map(tuple, first.collect()))
    S.commit(first.where("id < 7"), path, "0002", fmt="json")
    assert S.read_committed(spark, path).count() == 7 and S.read_committed(spark, path, "0001").count() == 100
    with pytest.raises(FileNotFoundError):
        S.read_committed(spark, path, "0003")


def test_a_writer_that_dies_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "sink")
    S.commit(spark.range(3), path, "0001")
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        S.commit(broken, path, "0002")
    assert S.versions(spark, path) == ["0001"] and S.read_committed(spark, path).count() == 3
    assert S.commit(spark.range(10), path, "0002")["rows"] == 10
    assert S.read_committed(spark, path).count() == 10


def test_a_lost_race_takes_the_winners_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sink")
    won = S.commit(spark.range(3), path, "0001")
    real, calls = S.manifest, []
    # the loser looked before the winner committed
    monkeypatch.setattr(S, "manifest", lambda *a: calls.append(a) or (None if len(calls) == 1 else real(*a)))
    assert S.commit(spark.range(50), path, "0001") == won
    assert S.read_committed(spark, path).count() == 3 and len(S.orphans(spark, path)) == 1


def test_empty_versions_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "sink")
    assert S.commit(spark.range(5).where("id > 9"), path, "0001")["rows"] == 0
    assert S.read_committed(spark, path).dtypes == [("id", "bigint")] and S.read_committed(spark, path).count() == 0


def test_envelopes_keep_the_newest_run_and_its_nulls(spark):
    rows = [("c1", "panel", 1, "old"), ("c1", "panel", 2, None), ("c1", "solo", 1, "x"), ("c2", None, 1, "y"), ("c1", "solo", 1, "w")]
    got = {(r.case_id, r.mode): r for r in S.envelopes(spark.createDataFrame(rows, "c string, m string, at int, out string"), "c", "m", ["at"], ["at", "out"]).collect()}
    assert set(got) == {("c1", "panel"), ("c1", "solo"), ("c2", None)}
    assert json.loads(got["c1", "panel"].body) == {"case_id": "c1", "mode": "panel", "at": 2, "out": None}
    assert json.loads(got["c1", "solo"].body)["out"] == "x" and got["c1", "solo"].file == "c1__solo.json"


def test_summary_counts_every_attempt_and_judges_by_the_newest(spark):
    d = Decimal
    rows = [("r", "panel", "failed", "timeout", d("0.5"), T0), ("r", "panel", "completed", None, d("0.25"), T0 + timedelta(1)),
            ("r", "solo", "refused", "over budget", d(0), T0), ("r", "wide", "failed", None, None, T0), ("q", None, "completed", "", d(1), None)]
    a = spark.createDataFrame(rows, "run_id string, mode string, status string, reason string, cost decimal(18,8), ts timestamp")
    got = {r.run_id: r for r in S.run_summary(a, cap=F.lit(2)).collect()}
    r = got["r"]
    assert r.modes_requested == ["panel", "solo", "wide"] and r.modes_completed == ["panel"] and r.modes_refused == {"solo": "over budget"}
    assert r.modes_failed == {"wide": ""} and r.spent == d("0.75") and r.cap == 2 and r.timestamp == T0 + timedelta(1)
    assert got["q"].modes_requested == [] and got["q"].spent == 1 and got["q"].timestamp is None
    outs = spark.createDataFrame([("r", "panel", "a|b\nc" + "z" * 300, 7), ("r", "panel", "short", 9), ("other", "solo", "x", 1)],
                                 "run_id string, mode string, output string, latency_ms long")
    docs = {p.run_id: json.loads(p.payload) for p in S.report_payload(S.run_summary(a), outs).collect()}
    assert set(docs) == {"r", "q"} and docs["q"]["outputs"] == []
    (o,) = docs["r"]["outputs"]
    assert o["mode"] == "panel" and o["chars"] == 305 and o["latency_ms"] == 7 and o["excerpt"].startswith("a/b cz") and len(o["excerpt"]) == 180
