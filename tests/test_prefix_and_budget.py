"""Running totals by a tree, and budgets composed from ranges, against plain walks."""

import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import prefix
from ledgerloom.operators import ranks as R
from ledgerloom.sources import ledger as L
from ledgerloom.streaming import budget as B

VALUES = [0.0, -0.0, 1e-300, -1e-300, 5e-324, 1e300, -1e300, float("inf"), float("-inf"), 1.0, 1.0 + 2 ** -52, -1.0, 1e9, 1e-9, 3.5, None]


def test_sortable_keeps_the_order(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double").select("v", prefix.sortable("v").alias("k"))
    rows = sorted((r for r in df.collect() if r["v"] is not None), key=lambda r: r["v"])
    for a, b in zip(rows, rows[1:]):
        assert a["k"] < b["k"] if a["v"] < b["v"] else a["k"] == b["k"]
    assert df.where("v IS NULL AND k IS NULL").count() == 1


@pytest.mark.parametrize("by", [[], ["g"]])
def test_below(spark, monkeypatch, by):
    rng = random.Random(2)
    monkeypatch.setattr(prefix, "BRANCH", 8)
    monkeypatch.setattr(prefix, "TWIG", 3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-3000, 3000), k, rng.randrange(5)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, x long, id long, n long").repartition(4)
    got = prefix.below(df, by, F.col("x"), ["n"], ["x", "id"]).toPandas()
    want = pd.DataFrame(rows, columns=["g", "x", "id", "n"]).sort_values(["x", "id"])
    want["g"] = want["g"].fillna("-") if by else "-"
    want["below"] = want.groupby("g")["n"].cumsum() - want["n"]
    want["all"] = want.groupby("g")["n"].transform("sum")
    both = got.merge(want[["id", "below", "all"]], on="id")
    assert len(both) == 2000 and (both["n_below"] == both["below"]).all() and (both["n_all"] == both["all"]).all()


def test_quantiles_of_wide_values(spark):
    rng = random.Random(3)
    values = [rng.choice([1e9, 1e-9, -1e-9, -1e9]) * rng.random() for _ in range(501)]
    q = R.quantiles(spark.createDataFrame([("a", v) for v in values], "g string, v double"), ["g"], "v", {"m": "median", "p": 0.25}).collect()[0]
    assert q["m"] == sorted(values)[250] and q["p"] == sorted(values)[125]


def test_spearman(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, 300), rng.normal(size=300)
    y = y + x * 0.3
    rows = [(None if k % 2 else "g", float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))] + [("g", None, 1.0), ("one", 1.0, 1.0)]
    got = {r["g"]: (r["n"], r["rho"]) for r in R.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    for g, at in (("g", slice(0, None, 2)), (None, slice(1, None, 2))):
        want = pd.Series(x[at]).rank().corr(pd.Series(y[at]).rank())
        assert got[g][0] == 150 and abs(got[g][1] - want) < 1e-9
    assert got["one"] == (1, None)
    assert R.spearman(spark.createDataFrame([], "x double, y double"), "x", "y").collect() == [(0, None)]


def test_offsets_of_gappy_ids(spark):
    ids = [-(1 << 62), -5, 0, 7, 1 << 30, 1 << 45, (1 << 62) + 3]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)] + [(None, 9)], "unit_id long, n int")
    got = {r["unit_id"]: r["offset"] for r in L.global_offsets(df, "unit_id", F.col("n")).collect()}
    assert got == {i: sum(range(k)) for k, i in enumerate(ids)}


def naive(rows, cap):
    out, spent = {}, {}
    for ledger, seq, cost in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or 0)):
        cost, held = cost or Decimal(0), spent.get(ledger, Decimal(0))
        ok = held + cost <= cap
        spent[ledger] = held + cost if ok else held
        out[(ledger, seq)] = (cost, ok, spent[ledger])
    return out


@pytest.mark.parametrize("size,ahead", [(3, 1), (7, 2), (4096, 64)])
@pytest.mark.parametrize("refunds", [False, True])
def test_budget(spark, size, ahead, refunds):
    rng = random.Random(size)
    rows = []
    for ledger, kind in (("even", 0), ("mixed", 1), (None, 2), ("tiny", 3)):
        for k in range(220):
            cost = [Decimal(rng.randrange(1, 400)) / 100, Decimal(2) ** rng.randrange(-8, 6), Decimal(rng.randrange(0, 3)),
                    Decimal(1) / 10 ** 8 if k % 2 else Decimal(99)][kind]
            rows.append((ledger, k * 1000 - 5, -cost if refunds and k % 50 == 49 else None if k % 71 == 0 else cost))
    df = spark.createDataFrame(rows, "ledger_id string, seq long, cost decimal(18,8)").repartition(3)
    got = {(r["ledger_id"], r["seq"]): (r["cost"], r["accepted"], r["spent"]) for r in B.budget_guard(df, "40.5", size, ahead).collect()}
    assert got == naive(rows, Decimal("40.5"))


def test_one_ledger_in_many_tasks(spark):
    rows = [("all", k, Decimal(k % 13 + 1)) for k in range(4000)]
    df = spark.createDataFrame(rows, "ledger_id string, seq long, cost decimal(18,8)")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = B.budget_guard(df, "9000", size=100).withColumn("task", F.spark_partition_id())
        assert got.select("task").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["ledger_id"], r["seq"]): r["accepted"] for r in got.collect()} == {k: v[1] for k, v in naive(rows, Decimal(9000)).items()}
    assert B.budget_guard(df.limit(0), "1").count() == 0


def test_summaries_settle_most_ranges():
    """A range is opened only where its summary can't tell."""
    rng = random.Random(1)
    for _ in range(300):
        costs = np.array([2 ** rng.randrange(12) + rng.randrange(3) for _ in range(20)])
        left = rng.randrange(0, 6000)
        classes = [{"least": int(c.min()), "largest": int(c.max()), "total": int(c.sum())}
                   for b in {int(x).bit_length() for x in costs} for c in [costs[[int(x).bit_length() == b for x in costs]]]]
        told = B.settled(left, classes)
        assert told is None or told == B.walked(left, costs)[1]
    assert B.settled(10, [{"least": 11, "largest": 15, "total": 26}]) == 10
    assert B.settled(10, [{"least": 2, "largest": 3, "total": 10}]) == 0
    assert B.settled(10, [{"least": 2, "largest": 3, "total": 11}]) is None
