"""Guards that must fire, guards that must not, and what nulls and blanks give."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import guards as G
from ledgerloom.sources import ledger as L


def messages(df, *guards, key="id"):
    return sorted(tuple(r) for r in G.violations(df, [key], *guards).collect())


def test_probes_in_their_own_texts(spark):
    rows = [(1, ["Net  Present", "absent"], "the net present value", "x"), (2, ["value x"], "value", "x"), (3, [None, " "], "any", None),
            (4, None, "any", "x"), (5, ["A"], None, None), (6, ["a b"], "A\n\tB", None)]
    df = spark.createDataFrame(rows, "id int, probes array<string>, a string, b string")
    # (2): the probe spans two texts and occurs in neither
    assert messages(df, G.probe_in_text("probes", ["a", "b"], "the case")) == [
        (1, "probe 'Net  Present' occurs in the case"), (6, "probe 'a b' occurs in the case")]
    assert messages(df, G.probe_in_text("probes", ["a", "b"], "the case", fold=False)) == []


def test_ratio_seats_and_words(spark):
    df = spark.createDataFrame([(1, "x" * 85, "y" * 100, "legal", "legal"), (2, "x" * 84, "y" * 100, "legal", None), (3, None, "", None, None)],
                               "id int, a string, b string, s string, t string")
    ratio, twice = G.length_ratio("a", "b"), G.must_differ("s", "t", "one seat twice")
    assert messages(df, ratio) == [(2, "length ratio 0.84 outside 0.85 to 1.15"), (3, "length ratio 0.00 outside 0.85 to 1.15")]
    assert messages(df, twice) == [(1, "one seat twice"), (3, "one seat twice")]
    assert messages(df, G.must_agree("s", "t", "off route")) == [(2, "off route")]
    assert messages(df, G.words_in_text("s", ["LEG", "", "tax"], where="subq")) == [(i, "domain word 'leg' in subq") for i in (1, 2)]
    assert messages(df) == [] and messages(df, ratio, twice) == sorted(messages(df, ratio) + messages(df, twice))


def test_arms_differ_by_their_form_only(spark):
    rows = [("even", "x", "say ONE now", "ONE"), ("even", "y", "say TWO now", "TWO"), ("even", "z", "say TWO now", "TWO"),
            ("uneven", "x", "say ONE now", "ONE"), ("uneven", "y", "say TWO today", "TWO"),
            ("lacks", "x", "say ONE now", "ONE"), ("lacks", "y", "say now", "TWO"), ("bare", "x", "same", None), ("bare", "y", "same", ""),
            (None, "x", None, None), ("alone", "x", "anything", "any")]
    got = G.differ_beyond_form(spark.createDataFrame(rows, "cell string, arm string, prompt string, form string"), ["cell"], "arm").collect()
    assert sorted((r.cell, r.violation) for r in got) == [
        ("lacks", "arm 'y' lacks its own form"), ("lacks", "prompts differ by more than the form"), ("uneven", "prompts differ by more than the form")]


def test_files_against_their_fields(spark, tmp_path):
    long = "plain words to fill the page " * 3
    bodies = {
        "c1__panel": {"case_id": "c1", "mode": "panel", "model": "phi", "final_output": long},
        "c1__panel__2": {"case_id": "c1", "mode": "panel", "model": "phi", "final_output": long},
        "c2__panel": {"case_id": "c1", "mode": "panel", "model": "cell2-seed", "final_output": long},
        "c1__solo": {"case_id": "c1", "mode": "panel", "model": "seedling", "final_output": "  short  "},
        "c1": {"case_id": "c1", "mode": None, "model": None, "final_output": None},
    }
    for name, b in bodies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(b))
    (tmp_path / "c9__panel.json").write_text("{cut off")
    got = sorted(map(tuple, G.file_violations(L.read_envelopes(spark, str(tmp_path))).collect()))
    assert got == sorted([
        ("c2__panel", "case differs from the file name"), ("c2__panel", "batch tag in the model field"), ("c9__panel", "unreadable"),
        ("c1__solo", "mode differs from the file name"), ("c1__solo", "output under 50 characters"),
        ("c1", "file name is not <case>__<mode>"), ("c1", "no model"), ("c1", "output under 50 characters")])


def test_gaps_of_a_design(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("c", 9), (None, 1)], "arm string, case int")
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 2), (None, 1)], "arm string, case int")
    got = G.coverage_gaps(runs, wanted, "arm", "case", 2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 2, 1), ("b", 1, 1), ("b", 2, 0), (None, 1, 1)]))
    assert G.coverage_gaps(runs.where(F.lit(False)), wanted, "arm", "case").count() == 5
