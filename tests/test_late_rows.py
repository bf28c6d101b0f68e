"""Late rows of a stream: none lost, the same ones late as in the batch twin, marks that do not pile up."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.streaming import feed as S
from ledgerloom.streaming import late as Z

T0 = datetime(2026, 1, 1)
SCHEMA = "id long, batch long, ts timestamp"


def arrivals():
    """Six batches of ten minutes' rows; every seventh row comes two batches late, one has no time stamp."""
    rows = []
    for i in range(120):
        batch = i // 20 + (2 if i % 7 == 0 else 0)
        rows.append((i, batch, None if i == 50 else T0 + timedelta(minutes=i)))
    return rows


def expected(rows, minutes):
    late = set()
    for i, batch, ts in rows:
        before = [t for _, b, t in rows if b < batch and t is not None]
        if ts is None or before and ts < max(before) - timedelta(minutes=minutes):
            late.add(i)
    return late


def test_a_stream_with_late_files_loses_nothing(spark, tmp_path):
    rows = arrivals()
    df = spark.createDataFrame(rows, SCHEMA)
    path, ck, src = (str(tmp_path / x) for x in ("out", "ck", "in"))
    for b in range(8):
        df.where(F.col("batch") == b).coalesce(1).write.parquet(f"{src}/b{b}")
        live = spark.readStream.schema(SCHEMA).parquet(f"{src}/b*")
        # one restart of the query per arriving file: marks must survive it
        Z.write_split(live, path, ck, delay="15 minutes").awaitTermination()
    on_time, late = (sorted(r.id for r in Z.read_split(spark, path, t).collect()) for t in ("on_time", "late"))
    want = expected(rows, 15)
    assert set(late) == want and len(want) > 5
    assert sorted(on_time + late) == list(range(120))
    twin = Z.split_batches(df, "batch", delay="15 minutes")
    assert {r.id for r in twin.where("late").collect()} == want and twin.count() == 120
    assert len([p for p in (tmp_path / "out" / "mark").iterdir() if p.name.startswith("epoch=")]) == 2


def test_marks_run_over_blocks_of_batches(spark, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK", 3)
    rows = arrivals() + [(500, 40, T0 + timedelta(minutes=1)), (501, 41, T0 + timedelta(days=1))]
    got = Z.split_batches(spark.createDataFrame(rows, SCHEMA), "batch", delay="15 minutes").where("late").collect()
    assert {r.id for r in got} == expected(rows, 15)
    assert Z.split_batches(spark.createDataFrame([], SCHEMA), "batch").count() == 0
    # a row whose batch is unknown has no mark: it counts as arrived in the first batch
    assert [r.late for r in Z.split_batches(spark.createDataFrame([(1, None, T0)], SCHEMA), "batch").collect()] == [False]


def test_late_runs_return_to_their_windows(spark):
    rows = [(T0 + timedelta(minutes=m), False, False, n) for m, n in ((5, 1), (20, 0), (70, 2))]
    late = [(T0 + timedelta(minutes=50), False, False, 1), (T0 + timedelta(minutes=51), True, False, 1)]
    schema = "ts timestamp, quarantined boolean, floor_guard boolean, n_invented int"
    got = Z.settled_rate(spark.createDataFrame(rows, schema), spark.createDataFrame(late, schema)).orderBy("start").collect()
    assert [(r.runs, r.inventing, r.late_runs) for r in got] == [(3, 2, 1), (1, 1, 0)]


def test_history_keeps_two_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 5, T0 + timedelta(minutes=i)) for i in range(50)], SCHEMA)
    for b in range(5):
        df.where(F.col("batch") == b).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    S.keep_history(live, str(tmp_path / "hist"), ["ts"], str(tmp_path / "ck"), n=7).awaitTermination()
    left = sorted(p.name for p in (tmp_path / "hist").iterdir() if p.name.startswith("epoch="))
    assert left == ["epoch=3", "epoch=4"]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "hist" / "epoch=4")).collect()) == list(range(43, 50))
