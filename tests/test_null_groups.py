"""A group without a name is a group: what every other group gets, it gets too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bootstrap as B
from ledgerloom.operators import estimators as E
from ledgerloom.operators import labels as L
from ledgerloom.operators import pairs as D


@pytest.fixture(scope="module")
def audited(spark):
    """Two groups of equal rows, one named, one not."""
    rows = [(g, f"p{k % 7}", "w", k % 5, (k * k) % 3, int(k % 4 == 0), False) for g in ("a", None) for k in range(120)]
    df = spark.createDataFrame(rows, "condition string, prompt_id string, writer_id string, supply int, emitted int, n_invented int, floor_guard boolean")
    return df.withColumns({"arm": F.when(F.col("prompt_id") > "p3", "x").otherwise("y"), "present_mask": F.lit(1).cast("long")})


CASES = {
    "best_of_n": lambda a: E.best_of_n(a),
    "draws_needed": lambda a: E.draws_needed(a),
    "clean_rate": lambda a: E.clean_rate(a),
    "cluster_slope": lambda a: E.cluster_slope(a, "prompt_id", "supply", "emitted").drop("slope_lo", "slope_hi"),
    "cluster_difference": lambda a: E.cluster_difference(a, "prompt_id", "arm", "x", "y", "n_invented", by=["condition"]).drop("diff_lo", "diff_hi"),
    "mean_interval": lambda a: E.mean_interval(a, ["condition"], ["prompt_id", "supply"], "emitted").drop("mean_lo", "mean_hi"),
    "corner": lambda a: E.corner_verdict(E.shrinkage(a), E.strata(a)).select("condition", "monotone"),
    "did": lambda a: E.difference_in_differences(
        a.select("condition", "arm", (F.col("supply") % 2).alias("ch"), F.col("n_invented").alias("event")), "condition", "arm", "x", "y", "ch").drop("did_lo", "did_hi"),
}


@pytest.mark.parametrize("name", CASES)
def test_equal_groups_agree(audited, name):
    rows = [r.asDict() for r in CASES[name](audited).collect()]
    by = {g: sorted(str({k: v for k, v in r.items() if k != "condition"}) for r in rows if r["condition"] == g) for g in ("a", None)}
    assert by["a"] and by["a"] == by[None]


def test_intervals_are_there(audited):
    for got in (E.cluster_slope(audited, "prompt_id", "supply", "emitted").select("condition", F.col("slope_lo").alias("lo")),
                E.mean_interval(audited, ["condition"], ["prompt_id", "supply"], "emitted").select("condition", F.col("mean_lo").alias("lo")),
                E.cluster_difference(audited, "prompt_id", "arm", "x", "y", "n_invented", by=["condition"]).select("condition", F.col("diff_lo").alias("lo"))):
        assert {r["condition"]: r["lo"] is None for r in got.collect()} == {"a": False, None: False}


def test_label_groups(spark):
    rows = [(j, f"c{k}", "S1" if k % 3 else "S2") for j in ("a", None) for k in range(30)]
    v = spark.createDataFrame(rows, "judge string, case_id string, verdict string")
    w = L.win_share(v, ["judge"], "case_id")
    assert {r["judge"]: (r["decisive"], r["share_lo"] is None) for r in w.collect()} == {"a": (30, False), None: (30, False)}
    assert L.replication(w, w, ["judge"]).count() == 2
    arms = v.select(F.col("judge").alias("arm"), F.when(F.col("verdict") == "S1", 1).otherwise(0).alias("v"))
    assert L.directive_shift(arms, "arm", "a", "v").where("arm IS NULL AND shift_lo IS NOT NULL").count() == 1


def test_remaining(spark):
    work = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    done = spark.createDataFrame([(1, None), (2, "x")], "k int, verdict string")
    def due(*a):
        return sorted(str(r["k"]) for r in D.remaining(work, *a).collect())
    assert due(done, ["k"]) == ["1", "3", "None"]
    assert due(done, ["k"], ["verdict"]) == ["1", "3", "None"]
    assert due(done.select("k"), ["k"]) == ["3", "None"]


def test_keyed_draws_do_not_depend_on_the_partitions(spark):
    rows = [(f"g{k % 3}" if k % 5 else None, k, float(k % 11), None if k % 7 == 0 else 1.0) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    held = [{(r["g"], r["draw"]): (r["n"], r["x"], r["y"]) for r in B.draws_of(
        df.repartition(n), ["g"], ["x", "y"], key=["id"], draws=40, spread=s).collect()} for n, s in ((1, False), (7, False), (3, True))]
    assert held[0] == held[1] == held[2] and len(held[0]) == 4 * 40
    weights = B.unit_weights(["g1|1"], 40, 0)[0]
    assert set(np.unique(weights)) <= set(range(14))
