"""Evidence of inventions, detectors side by side, gates of judges, doses and requests: known answers, nulls and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import stats
from ledgerloom.operators import evidence as E
from ledgerloom.operators import labels as L
from ledgerloom.operators import pairs as D
from ledgerloom.operators import ranks as R

LEX = {"hedging": [r"\bmay\b", r"\bperhaps\b"], "cutoff": [r"\bas of\b"]}
LOOSE = {"hedging": [r"\bmay\b", r"\bperhaps\b", r"\blikely\b"], "cutoff": [r"\bas of \d+\b"]}
LONG = "A sentence that says nothing in particular at all. "
RUNS = "run_id int, upstream array<string>, output string"


def runs(spark):
    return spark.createDataFrame([
        (1, ["It may rain."], LONG + "The figures stand as of 2020 and Perhaps as of 2021, so we are told. As of now it may rain again, more or less."),
        (2, [None, ""], "Short. May. Perhaps. " + "x" * 20 + ". May May MAY."),
        (3, None, LONG), (4, ["may"], None), (5, [], "perhaps"), (6, ["as of"], LONG + "perhaps")], RUNS)


def test_flagged_phrases_and_excerpts(spark):
    got = {(r.run_id, r.family): (r.phrases, r.excerpt) for r in E.flagged(runs(spark), LEX, floor=10).collect()}
    assert got == {
        (1, "cutoff"): (["as of", "as of", "As of"], "The figures stand as of 2020 and Perhaps as of 2021, so we are told."),
        # five phrases are kept as evidence and four shown; no sentence is long enough for an excerpt
        (2, "hedging"): (["May", "May", "May", "MAY"], ""),
        (6, "hedging"): (["perhaps"], "")}
    cut = E.flagged(runs(spark), LEX, floor=10, shown=1, width=11).where("run_id = 1").collect()
    assert [(r.phrases, r.excerpt) for r in cut] == [(["as of"], "The figures")]
    assert E.flagged(runs(spark).limit(0), LEX).count() == 0


def test_feedback_and_annotation(spark):
    df = spark.createDataFrame([(1, {"zeta": ["a", "b", "c", "d"], "cutoff": ["as of"]}, 3), (2, {}, 0), (3, None, None)],
                               "id int, ev map<string,array<string>>, m bigint")
    got = [tuple(r) for r in df.select(E.feedback("ev"), E.annotation("m", LEX)).collect()]
    assert got[0][0].split("\n") == [
        E.FEEDBACK_HEAD, '- training-cutoff / recency disclaimers: "as of"', '- zeta: "a", "b", "c"', E.FEEDBACK_TAIL]
    assert got[0][1] == E.ANNOTATION_HEAD + "training-cutoff / recency disclaimers, hedging or variability qualifiers" + E.ANNOTATION_TAIL
    assert got[1:] == [(None, None), (None, None)]


def test_feedback_goes_to_answered_attempts(spark):
    bad, good = LONG + "perhaps", LONG
    rows = [(1, 0, bad), (1, 1, bad), (1, 2, bad), (1, 3, good),  # the budget ends at attempt 2, which nothing answers
            (2, 0, bad), (2, 1, good), (2, 2, bad), (3, 0, good), (3, 1, bad), (4, 0, bad), (5, 0, None), (5, 1, bad)]
    df = spark.createDataFrame([(r, a, [], o) for r, a, o in rows], "run_id int, attempt int, upstream array<string>, output string")
    got = E.feedback_sent(df, LEX, floor=10)
    assert sorted((r.run_id, r.attempt) for r in got.collect()) == [(1, 0), (1, 1), (2, 0)]
    assert all('"perhaps"' in r.feedback for r in got.collect())


def test_two_detectors(spark):
    df = runs(spark).unionByName(spark.createDataFrame([(7, [], LONG + "likely"), (8, ["likely"], LONG + "as of now")], RUNS))
    got = E.run_divergence(df, LEX, LOOSE, floor=10).first()
    assert got.asDict() == {"runs": 8, "both": 3, "only_a": 1, "only_b": 1, "neither": 3, "same_family": 3, "divergence": 0.25}
    assert {tuple(r) for r in E.supply_histograms(df, LEX, LOOSE).collect()} == {(0, 5, 5), (1, 3, 3)}  # run 6 raises for the first only, run 8 for the second
    none = E.run_divergence(df.limit(0), LEX, LOOSE).first()
    assert none.runs == 0 and none.both == 0 and none.divergence is None
    with pytest.raises(ValueError):
        E.run_divergence(df, LEX, {"hedging": ["x"]})


def test_grid_cut_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, y, s) for g in ("a", None) for _ in range(60) for y in [rng.random() < .4]
            for s in [round(min(1.0, max(0.0, rng.gauss(.6 if y else .4, .2))), 2)]]
    rows += [("few", True, .9)] * 9 + [("few", False, .1)] * 4 + [("a", None, .5), ("a", True, None)]
    want = {}
    for g in {r[0] for r in rows}:
        pos = [s for h, y, s in rows if h == g and y and s is not None]
        neg = [s for h, y, s in rows if h == g and y is not None and not y]
        j = [(round(sum(s >= t / 100 for s in pos) / len(pos) - sum(s >= t / 100 for s in neg) / len(neg), 12), -t) for t in range(5, 100, 5)]
        best = max(j)
        want[g] = (len(pos), len(neg), -best[1] / 100, best[0]) if min(len(pos), len(neg)) >= 5 else (len(pos), len(neg), None, None)
    got = R.youden_grid(spark.createDataFrame(rows, "g string, y boolean, s double"), ["g"], "y", "s").collect()
    assert {r.g: (r.n_pos, r.n_neg, r.cut, r.j) for r in got} == want


def test_batch_gates(spark):
    labels = [(size, u, j, f, v) for size in (1, 5) for u in range(10) for j in ("p", "q") for f in ("x", "y")
              for v in [None if size == 5 and j == "q" and u in (0, 1) else u % 2 == 0]]
    labels += [(1, 0, "stranger", "x", False)]
    truth = [(u, f, u % 2 == 0, u < 3) for u in range(10) for f in ("x", "y")]
    batches = [(1, j, True) for j in "pq" for _ in range(10)] + [(5, "p", True)] * 4 + [(5, "q", True)] * 4 + [(5, "q", False), (5, "q", None)]
    make = spark.createDataFrame
    gates = L.batch_gates(make(labels, "size int, unit int, judge string, family string, value boolean"),
                          make(truth, "unit int, family string, truth boolean, anchor boolean"),
                          make(batches, "size int, judge string, parsed boolean"), "p", "q", ["x", "z"])
    got = {(r["size"], r.gate, r.subject): (r.n, r.hits, r.ok) for r in gates.collect()}
    assert got == {
        (1, "parse", "p"): (10, 0, True), (1, "parse", "q"): (10, 0, True), (5, "parse", "p"): (4, 0, True), (5, "parse", "q"): (6, 2, False),
        (1, "consistency", "x"): (7, 7, True), (5, "consistency", "x"): (7, 7, True),
        (1, "consistency", "z"): (0, 0, False), (5, "consistency", "z"): (0, 0, False),
        (1, "anchor", "p"): (6, 6, True), (1, "anchor", "q"): (6, 6, True), (5, "anchor", "p"): (6, 6, True), (5, "anchor", "q"): (2, 2, True)}
    verdict = {r["size"]: (r.gates, r.failed, r.passes, r.shipped) for r in L.batch_verdict(gates.where("subject <> 'z'")).collect()}
    assert verdict == {1: (5, 0, True, True), 5: (5, 1, False, False)}
    assert not any(r.shipped for r in L.batch_verdict(gates).collect())


def test_fates_per_judge(spark):
    rows = [(u, j, f) for u, one, two in [(1, "R", "R"), (2, "R", "D"), (3, None, "D"), (4, "D", "D"), (5, None, None)] for j, f in (("one", one), ("two", two))]
    got = L.fate_marginals(spark.createDataFrame(rows, "unit int, judge string, fate string"), ["unit"], "one", "two").collect()
    assert {(r.rater, r.fate): (r.n, r.usable) for r in got} == {
        ("one", "R"): (2, 3), ("one", "D"): (1, 3), ("two", "R"): (1, 4), ("two", "D"): (3, 4), ("agreed", "R"): (1, 2), ("agreed", "D"): (1, 2)}
    lo, hi = stats.wilson(F.lit(2), F.lit(3))
    one = next(r for r in got if (r.rater, r.fate) == ("one", "R"))
    assert (one.share_lo, one.share_hi) == tuple(spark.range(1).select(lo, hi).first())


def test_dose_by_hashed_order(spark):
    rows = [(i, g) for i, g in enumerate(["a"] * 3000 + ["b"] * 7 + [None] * 20)]
    got = D.dose_match(spark.createDataFrame(rows, "id int, g string").repartition(4), "g", "id", seed=9).collect()
    for g in ("a", "b", None):
        ids = sorted((i for i, h in rows if h == g), key=lambda i: hashlib.md5(b"9|%d" % i).hexdigest())
        assert {r.id for r in got if r.g == g} == set(ids[:7])
    assert D.dose_match(spark.createDataFrame([], "id int, g string"), "g", "id").count() == 0


def test_pair_requests(spark):
    pairs = spark.createDataFrame([(1, "q", "x", "y"), (2, None, None, "z"), (None, "q", "x", "y"), (3, "q", "x", "y")],
                                  "id int, question string, first string, second string")
    done = spark.createDataFrame([(1, "p", "fwd", "A"), (1, "p", "fwd", "B"), (1, "p", "rev", None), (1, "stranger", "rev", "A"), (None, "p", "fwd", "A")]
                                 + [(3, j, o, "TIE") for j in "pq" for o in ("fwd", "rev")], "id int, judge string, ordering string, verdict string")
    got = {(r.id, r.judge, r.ordering): r.body for r in D.pair_requests(pairs, "id", ["p", "q"], done).collect()}
    every = [(j, o) for j in "pq" for o in ("fwd", "rev")]
    assert set(got) == {(1, *e) for e in every if e != ("p", "fwd")} | {(i, *e) for i in (2, None) for e in every}
    assert got[1, "p", "rev"] == "Question:\nq\n\n--- Response A ---\ny\n\n--- Response B ---\nx"
    assert got[2, "q", "fwd"] == "Question:\n\n\n--- Response A ---\n\n\n--- Response B ---\nz"
    assert D.pair_requests(pairs, "id", ["p"]).count() == 8


def test_property_requests(spark):
    names = {"a": "one", "b": "two", "c": "three"}
    units = spark.createDataFrame([(i, "t") for i in range(200)] + [(None, "t")], "id int, text string")
    done = spark.createDataFrame([(0, True), (1, None)], "id int, result boolean")
    got = D.property_requests(units, "id", names, done, seed=5).collect()
    assert {r.id for r in got} == {None, *range(1, 200)}
    for r in got:
        key = "~" if r.id is None else str(r.id)
        want = sorted(names, key=lambda n: hashlib.md5(f"5|{key}|{n}".encode()).hexdigest())
        assert r.properties == want and r.definitions == "\n".join(f"- {n}: {names[n]}" for n in want)
    assert len({tuple(r.properties) for r in got}) == 6
