"""Detectors of every kind give the operators what a lexicon gives them."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.detectors import Called, Consensus, Lexical, Scored, Table, detector
from ledgerloom.operators import estimators as E
from ledgerloom.operators import pairs as D
from ledgerloom.operators import provenance as V

LEX = {"red": [r"\bred\w*"], "blue": [r"\bblue", r"navy"]}
TEXTS = ["Red roof. A blue sky. Nothing here.", "navy and redder walls! plain words.", "", None, "no colour at all.\nbluered"]


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(k, "c", [TEXTS[(k + 1) % 5] or "", "red one."], t) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "run_id long, condition string, upstream array<string>, output string")


def caller():
    def called(texts):  # within a function, so that workers get it by value
        return [[(m.start(), m.end(), f) for f, ps in LEX.items() for p in ps for m in re.finditer(p, t, re.I)] + [(0, 1, "unknown")] for t in texts]
    return called


called = caller()


def as_table(spark, runs, **more):
    rows = []
    for r in runs.collect():
        for part, text in (("output", r["output"]), ("upstream", "\n\n".join(x for x in r["upstream"] if x))):
            rows += [(r["run_id"], part, f, a, b, 0.9) for a, b, f in called([text or ""])[0]]
            rows += [(r["run_id"], part, "red", 0, 1, 0.1)]
    det = spark.createDataFrame(rows, "run_id long, part string, family string, start int, end int, score double")
    return Table(det, list(LEX), thresholds={f: 0.5 for f in LEX}, **more)


def seen(df):
    return sorted(map(str, df.collect()))


def test_same_findings_same_results(spark, runs):
    table = as_table(spark, runs)
    for det in (Lexical(LEX), Called(called, list(LEX)), table, Consensus([LEX, Called(called, list(LEX))], 2), Consensus([LEX, table], 1)):
        assert seen(V.audit(runs, det, floor=5)) == seen(V.audit(runs, LEX, floor=5))
        assert seen(D.ablate(runs, "output", det)) == seen(D.ablate(runs, "output", LEX))
        assert seen(D.feature_mask(runs, "output", det)) == seen(D.feature_mask(runs, "output", LEX))
        assert seen(E.span_fraction(runs, det, min_chars=1)) == seen(E.span_fraction(runs, LEX, min_chars=1))
        refs = runs.withColumn("t", F.array(F.lit("red"), F.lit("blue")))
        assert seen(D.drop_pairs(refs, "output", "t", det, ["run_id"], min_chars=1)) == seen(D.drop_pairs(refs, "output", "t", LEX, ["run_id"], min_chars=1))


def test_table_needs_no_text(spark, runs):
    plan = V.audit(runs, as_table(spark, runs))._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower()


def test_consensus(runs):
    loose = {"blue": [r"sky"], "green": [r"walls"]}
    two = Consensus([LEX, loose], 2)
    assert two.names == ["red", "blue", "green"]
    got = {r["run_id"]: (r["present_mask"], [tuple(s) for s in r["s"]]) for r in V.audit(runs, two, floor=0, evidence=False).join(
        runs.select("run_id", two.spans("output", F.col("output")).alias("s")), "run_id").collect()}
    assert got[0] == (2, [(12, 16, "blue"), (17, 20, "blue")]) and got[1][0] == 0
    with pytest.raises(ValueError):
        Consensus([LEX], 1)
    with pytest.raises(ValueError):
        Consensus([LEX, loose], 3)


def test_scored(runs):
    det = Scored({"long": lambda s: F.length(s), "never": lambda s: F.lit(None).cast("double"), "unset": lambda s: F.lit(1)},
                 {"long": 12, "never": 0.0})
    assert det.names == ["long", "never"]
    got = {r["run_id"]: [tuple(s) for s in r["s"]] for r in runs.select("run_id", det.spans("output", F.col("output")).alias("s")).collect()}
    assert got == {0: [(22, 35, "long")], 1: [(0, 22, "long"), (23, 35, "long")], 2: [], 3: [], 4: [(0, 17, "long")]}
    assert {r["run_id"]: r["m"] for r in runs.select("run_id", det.mask("output", F.col("output")).alias("m")).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}


def test_transmission_takes_a_detector(runs):
    det = Called(called, list(LEX))
    got = V.transmission(V.audit(runs, det, floor=1), det, draws=40)
    assert {r["family"] for r in got.collect()} == {"red", "blue"}
    assert detector(det) is det and isinstance(detector("prose"), Lexical)
