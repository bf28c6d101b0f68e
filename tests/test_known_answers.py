"""Synthetic runs with known answers: the estimators must recover them and the guards must refuse."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.lexicons import EPISTEMIC, lexicon
from ledgerloom.operators import cards as C
from ledgerloom.operators import dictation, labels as L, pairs as D
from ledgerloom.operators import estimators as E
from ledgerloom.operators import hygiene as P
from ledgerloom.operators import provenance as V
from ledgerloom.operators import detection as T
from ledgerloom.operators import ranks as R

MARK = {"cutoff": "Please verify current figures.", "modeled": "We assume steady demand.",
        "jurisd": "Rules differ in each country.", "hedging": "Outcomes may vary by site."}
FILL = "The plan covers staffing, rooms and transport in plain terms without further comment. " * 8


def text(k, start=0):
    fams = list(MARK)
    return " ".join([MARK[f] for f in fams[start:start + k]] + [FILL])


def runs(spark, rows):
    """rows: (run_id, prompt, condition, supply, emitted)"""
    data = [(str(r), p, c, "w", [text(s), "Filler only."], text(e)) for r, p, c, s, e in rows]
    return spark.createDataFrame(data, "run_id string, prompt_id string, condition string, writer_id string, "
                                       "upstream array<string>, output string")


def fit(spark, levels, per, emitted):
    rows = [(f"{s}-{i}", f"p{i % 5}", "arm", s, emitted(s, i)) for s in levels for i in range(per)]
    a = V.audit(runs(spark, rows), "epistemic")
    return E.shrinkage(a, ["condition"], families=4, draws=400).first()


def test_known_law(spark):
    r = fit(spark, range(5), 30, lambda s, i: round(0.5 * s + 1))
    assert abs(r.w - 0.5) < 0.12 and abs(r.c - 1.0) < 0.25 and r.identifiable


def test_faithful(spark):
    r = fit(spark, range(5), 20, lambda s, i: s)
    assert r.w > 0.85 and r.c < 0.15 and r.verdict == "faithful transduction"


def test_no_variation_is_unidentifiable(spark):
    r = fit(spark, [2], 50, lambda s, i: 2)
    assert r.verdict == "unidentifiable" and r.w is None and r.c is None


def test_no_zero_supply_is_extrapolated(spark):
    r = fit(spark, [2, 3, 4], 20, lambda s, i: s)
    assert r.extrapolated and r.verdict == "c extrapolated"


def test_noise_is_weak(spark):
    r = fit(spark, [0, 2, 4], 5, lambda s, i: 4 if i % 2 else 0)
    assert r.weak and r.verdict == "weakly identified"


def clean(spark, rows):
    """rows: (prompt, condition, clean)"""
    return E.best_of_n(V.audit(runs(spark, [
        (f"{p}-{c}-{i}", p, c, 0, 0 if ok else 1) for i, (p, c, ok) in enumerate(rows)]).withColumn("all", F.lit(1)), "epistemic"), ["all"])


def test_correlated_redraws(spark):
    curve = {r.draws: r for r in clean(spark, [("bad", "a", False)] * 6 + [("good", "a", True)] * 6).collect()}
    assert curve[2].empirical == pytest.approx(0.5) and curve[2].independent == pytest.approx(0.75)


def test_arms_are_not_redraws(spark):
    curve = {r.draws: r for r in clean(spark, [("p", "a", False)] * 4 + [("p", "b", True)] * 4).collect()}
    assert curve[2].empirical == pytest.approx(0.5)


def test_best_of_n_matches_enumeration(spark):
    from itertools import combinations

    cells = [[1, 0, 0], [1, 1, 0, 0, 0], [0, 0]]
    rows = [(f"p{i}", "a", bool(v)) for i, c in enumerate(cells) for v in c]
    curve = {r.draws: r for r in clean(spark, rows).collect()}
    for n in (1, 2, 3):
        hits = [sum(any(d) for d in combinations(c, n)) / len(list(combinations(c, n))) for c in cells if len(c) >= n]
        assert curve[n].empirical == pytest.approx(sum(hits) / len(hits)) and curve[n].cells == len(hits)


def test_four_against_seven_events(spark):
    rows = [(f"{c}{i}", "p", c, 0, 1 if i < k else 0) for c, k in (("base", 7), ("few", 4), ("none", 0)) for i in range(45)]
    rows += [(f"all{i}", "p", "all", 0, 1) for i in range(45)]
    d = {r.condition: r.verdict for r in E.mean_difference(V.audit(runs(spark, rows), "epistemic"), "base", draws=400).collect()}
    assert d["few"] == "not distinguishable" and d["all"] == "higher than baseline"


def test_unequal_batteries(spark):
    rows = [(f"a{i}", f"p{i}", "a", 0, 0) for i in range(5)] + [(f"b{i}", f"p{i}", "b", 0, 0) for i in range(3)]
    r = runs(spark, rows)
    assert {x.condition: x.comparable for x in E.check_comparable(r).collect()} == {"a": False, "b": True}
    assert E.restrict_to_shared(r).select("prompt_id").distinct().count() == 3


def test_floor_guard(spark):
    r = spark.createDataFrame([("r", "p", "c", "w", [MARK["cutoff"]], "short " + MARK["modeled"])],
                              "run_id string, prompt_id string, condition string, writer_id string, upstream array<string>, output string")
    a = V.audit(r, "epistemic").first()
    assert a.floor_guard and a.n_kept == 0 and a.n_invented == 0 and a.traceability == 0.0 and a.discarded_mask == a.raised_mask
    _, dropped = P.partition(r)
    assert dropped.first().reason.startswith("output ") and "< floor 500" in dropped.first().reason


def test_selection_and_note_round_trip(spark):
    up = [text(1)]
    c = spark.createDataFrame([("p", 0, up, text(2)), ("p", 1, up, text(1)), ("q", 0, up, text(2)), ("q", 1, up, text(3))],
                              "prompt_id string, cand int, upstream array<string>, output string")
    best = {r.prompt_id: r for r in V.select_best(c, "epistemic").withColumn("back", X.strip_note("chosen")).collect()}
    assert best["p"].cand == 1 and not best["p"].annotated
    assert best["q"].cand == 0 and best["q"].annotated and "modeled" in best["q"].chosen and best["q"].back == text(2)


def test_ablation_and_variants(spark):
    d = spark.createDataFrame([(text(2), ["modeled"])], "t string, drop array<string>")
    out = D.ablate(d, "t", "epistemic", drop="drop").first().ablated
    assert MARK["cutoff"] in out and MARK["modeled"] not in out
    v = D.supply_variants(runs(spark, [("r", "p", "c", 3, 0)]), "epistemic", ["run_id"]).collect()
    assert sorted(r.supply for r in v) == [0, 1, 2, 3]


def test_balanced_corpus(spark):
    r = runs(spark, [(f"r{i:02d}", f"p{i:02d}", "c", 3, 0) for i in range(12)])
    d = E.decorrelation(D.build_corpus(r, "epistemic")).first()
    assert d.n_items == 48 and d.nmi < 0.15 and d.balanced and d.small


def test_pairs(spark):
    ref = spark.createDataFrame([("r", text(2), ["cutoff", "modeled"])], "id string, t string, target array<string>")
    drop = D.drop_pairs(ref, "t", "target", "epistemic", ["id"])
    diag = D.diagnose(D.diagnose_pairs(drop, "epistemic", ["id"]), ["id"]).first()
    assert diag.n == 2 and diag.minimal and diag.off_feature == 0.0
    inv = D.invention_pairs(ref, "t", "target", {"hedging": MARK["hedging"], "cutoff": MARK["cutoff"]}, "epistemic", ["id"]).collect()
    assert [p.family for p in inv] == ["hedging"] and MARK["hedging"] in inv[0].rejected
    other = spark.createDataFrame([("x", text(1), "Entirely different wording follows here, without any shared structure at all. " * 6)], "id string, chosen string, rejected string")
    assert D.diagnose_pairs(other, "epistemic", ["id"]).first().off_feature > 0.5


def test_blindspot(spark):
    p = spark.createDataFrame([(3, 3, 1), (3, 3, 1)], "truth_mask long, loose long, tight long")
    m = C.blindspot(p, {"loose": "loose", "tight": "tight"})
    assert {r.instrument: r.miss_rate for r in m.collect()} == {"loose": 0.0, "tight": 0.5}
    assert C.joint_miss(m).first().joint == 0.0


def test_entangled_lexicon(spark):
    from ledgerloom.operators.detection import scaffold_overlap

    prompts = spark.createDataFrame([("Say modeled at ten.",)], "t string")
    r = scaffold_overlap(prompts, "t", {"modeled": [r"modell?ed at", r"under the assumption"]}).collect()
    assert sorted(x.dictated for x in r) == [False, True]


def test_spans_and_families_match_python(spark):
    samples = [text(4), "x UK GDPR applies", "5± 2 and 5±2", "HYPOTHETICAL line may vary", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = df.select("i", X.families("t", "epistemic").alias("f"), X.spans("t", "epistemic").alias("s")).orderBy("i").collect()
    for row, s in zip(got, samples):
        want = sorted((m.start(), m.end(), f) for f, ps in EPISTEMIC.items() for p in ps for m in re.finditer(p, s or "", re.I))
        assert [tuple(x) for x in row.s] == want and row.f == sorted({f for *_, f in want})


def test_spans_and_families_share_an_engine(spark):
    """Control characters and Unicode white space count alike for families and spans; long texts keep their offsets."""
    samples = [f"each{c}country stands" for c in "\x1c\x1f\x85\u00a0\u2003\u200b\n\t"] + ["\U0001f600 each country. " * 700, "each country"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = df.select("i", "t", X.families("t", "epistemic").alias("f"), X.spans("t", "epistemic").alias("s"), X.sentence_offsets("t").alias("o"))
    for r in got.collect():
        assert r.f == sorted({x.family for x in r.s})
    long = next(r for r in got.collect() if r.i == len(samples) - 2)
    assert [x.start for x in long.s if x.family == "jurisd"] == [16 * k + 2 for k in range(700)]
    assert [(x.start, x.end) for x in long.o] == [(16 * k, 16 * k + 15) for k in range(700)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_sentence_offsets_agree_with_sentences(spark):
    df = spark.createDataFrame([("One. Two?  Three\n\nfour! \n five",), ("",), ("no end",)], "t string")
    for r in df.select("t", X.sentences("t").alias("s"), X.sentence_offsets("t").alias("o")).collect():
        assert [r.t[x.start:x.end] for x in r.o] == r.s


def test_literal_hits_both_ways(spark):
    texts = spark.createDataFrame([(1, "Alpha bravo charlie delta"), (2, "xALPHA BRAVO Cy"), (3, "nothing"), (4, None)], "k int, t string")
    reg = spark.createDataFrame([(10, "alpha bravo c"), (11, "bravo charlie"), (12, "delta"), (13, "Alpha Bravo C")], "id int, phrase string")
    want = {(1, 10), (2, 10), (1, 11), (1, 13), (2, 13)}
    assert {tuple(r) for r in dictation.literal_hits(texts, ["k"], "t", reg).collect()} == want
    short = spark.createDataFrame([(1, "a"), (2, "zz"), (3, "delta" * 9)], "id int, phrase string")
    assert {tuple(r) for r in dictation.literal_hits(texts, ["k"], "t", short, min_len=1).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_literal_hits_null_and_repeated_keys(spark, monkeypatch, limit):
    """Broadcast or shuffled, every row of the texts has its own hits."""
    monkeypatch.setattr(dictation, "BROADCAST_ANCHORS", limit)
    texts = spark.createDataFrame([(None, "alpha bravo charlie"), (1, "alpha bravo charlie"), (1, "alpha bravo charlie"), (1, "other words")], "k int, t string")
    reg = spark.createDataFrame([(10, "alpha bravo"), (10, "alpha bravo"), (11, "")], "id int, phrase string")
    got = sorted((r.k is None, r.id) for r in dictation.literal_hits(texts, ["k"], "t", reg).collect())
    assert got == [(False, 10), (False, 10), (True, 10)]


def test_literal_hits_of_a_large_registry(spark):
    """A registry beyond 100,000 phrases answers as its part that can hit."""
    reg = spark.range(120_000).select(F.col("id"), F.concat(F.lit("phrase number "), F.col("id"), F.lit(" ends")).alias("phrase"))
    texts = spark.createDataFrame([(1, "x phrase number 77 ends, Phrase Number 119999 ends"), (2, "phrase number 120001 ends")], "k int, t string")
    assert {tuple(r) for r in dictation.literal_hits(texts, ["k"], "t", reg).collect()} == {(1, 77), (1, 119999)}


def test_sign_test_is_exact(spark):
    from math import comb

    cases = [(0, 0), (5, 0), (3, 3), (9, 2), (40, 60)]
    df = spark.createDataFrame(cases, "w int, l int")
    for r in df.select("w", "l", L.sign_test("w", "l").alias("p")).collect():
        n, k = r.w + r.l, max(r.w, r.l)
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k, n + 1)) / 2 ** n) if n else 1.0
        assert r.p == pytest.approx(want)
    large = spark.createDataFrame([(50_000_000, 50_000_000), (50_005_000, 49_995_000), (10**9, 0)], "w long, l long")
    p = [r.p for r in large.select(L.sign_test("w", "l").alias("p")).collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(math.erfc(0.9999 / 2 ** 0.5), rel=1e-4) and p[2] == 0.0


def test_auc_and_youden_by_brute_force(spark):
    from ledgerloom.operators import ranks as R

    data = [(1, i % 3 == 0, round(((i * 37) % 20) / 20, 4)) for i in range(60)]
    df = spark.createDataFrame(data, "g int, y boolean, s double")
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert R.auc(df, ["g"], "y", "s").first().auc == pytest.approx(want)
    best = max(sorted({s for *_, s in data} | {0.0, 1.0}), key=lambda t: (round(
        sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg), 12), -t))
    assert R.youden(df, ["g"], "y", "s").first().cut == pytest.approx(best)


def test_multinomial_and_poisson_agree(spark):
    from ledgerloom.operators import bootstrap as B

    units = spark.createDataFrame([("a", i, float(i % 4)) for i in range(80)], "g string, k int, v double")
    rate = F.col("v") / F.col("n")
    p = B.intervals(B.draws_of(units, ["g"], ["v"], draws=400), ["g"], draws=400, m=rate).first()
    m = B.intervals(B.multinomial_draws(units, ["g"], ["v"], ["k"], draws=400), ["g"], draws=400, m=rate).first()
    assert abs(p.m_lo - m.m_lo) < 0.12 and abs(p.m_hi - m.m_hi) < 0.12
    sizes = {r.n for r in B.multinomial_draws(units, ["g"], ["v"], ["k"], draws=40).collect()}
    assert sizes == {80.0}


@pytest.mark.parametrize("m", [15, 16, 64, 65, 1000, 10**7])
def test_cell_weights_follow_poisson(spark, m):
    """Cells on both sides of the sampler's bound, and very large ones, follow the same law."""
    from ledgerloom.operators import bootstrap as B

    cells = spark.createDataFrame([("a", 1.0, m)], "g string, v double, _m long")
    got = np.sort([r.n for r in B.draws_of_cells(cells, ["g"], ["v"], draws=4000).collect()])
    assert len(got) == 4000 and abs(got.mean() - m) < 4 * (m / 4000) ** 0.5
    assert 0.9 < got.var() / m < 1.1
    k = np.arange(max(0, m - int(12 * m ** 0.5)), m + int(12 * m ** 0.5) + 30)
    mass = np.exp(k * math.log(m) - m - np.array([math.lgamma(x + 1) for x in k]))
    steps = np.abs(np.searchsorted(got, k, "right") / 4000 - np.cumsum(mass) / mass.sum())
    assert steps.max() < 1.63 / 4000 ** 0.5


def test_partitioning_changes_nothing(spark):
    rows = [(f"{s}-{i}", f"p{i % 5}", "arm", s, (s + i) % 5) for s in range(5) for i in range(20)]
    a = V.audit(runs(spark, rows), "epistemic")
    one, many = (E.shrinkage(a.repartition(n), ["condition"], draws=400).drop("thin").first() for n in (1, 7))
    assert one == many


def test_kept_and_invented_make_up_the_output(spark):
    rows = [(f"{s}-{e}", "p", "c", s, e) for s in range(5) for e in range(5)]
    a = V.audit(runs(spark, rows), "epistemic")
    assert a.where("(kept_mask | invented_mask) <> present_mask or (kept_mask | discarded_mask) <> raised_mask").count() == 0


def test_lexicon_limits():
    with pytest.raises(ValueError):
        lexicon({f"f{i}": ["x"] for i in range(63)})


def test_null_group_keeps_its_numbers(spark):
    rows = [("x" if k % 2 else None, k % 5, (k % 5) // 2 + 1) for k in range(200)]
    a = spark.createDataFrame([(c, s, e, False) for c, s, e in rows], "condition string, supply int, emitted int, floor_guard boolean")
    got = {r.condition: r for r in E.shrinkage(a, ["condition"], draws=400).collect()}
    assert set(got) == {None, "x"} and got[None].n_runs == 100 and got[None].w_lo is not None
    assert abs(got[None].w - got["x"].w) < 1e-9
    q = {r.condition: r.n for r in R.quantiles(a, ["condition"], "supply", {"m": "median"}).collect()}
    assert q == {None: 100, "x": 100}


def test_compression_of_nothing_is_null(spark):
    flat = spark.createDataFrame([("a", float(s), float(s - 1)) for s in (1, 2, 3, 4) for _ in range(3)], "g string, x double, y double")
    f = E.ols(flat, "x", "y", ["g"]).select(E.compression("slope", "intercept", 1.0, 4.0).alias("c")).first()
    assert f.c is None


def test_digest_is_one_row_at_any_reach(spark):
    t = spark.range(40).selectExpr("id * 1000 - 5000 AS id")
    assert T.registry_digest(t, "id", "id", fan=2, levels=3).count() == 1


def test_diagnosis_of_splices(spark):
    a = "One two three. Four modeled at five. Six seven."
    rows = [("cut", a, "One two three. Six seven."), ("same", a, a), ("word", a, a.replace("seven", "eight")), ("none", "", "")]
    got = {r.id: r for r in D.diagnose_pairs(spark.createDataFrame(rows, "id string, chosen string, rejected string"), {"m": ["modeled at"]}, ["id"]).collect()}
    assert (got["cut"].differing, got["cut"].off_feature) == (4 / 14, 0.0)
    assert (got["same"].differing, got["none"].differing) == (0.0, 0.0)
    assert (got["word"].differing, got["word"].off_feature) == (2 / 18, 1.0)


def test_leak_screen_of_short_terms(spark):
    prompts = spark.createDataFrame(
        [(1, "Early SEPSIS signs"), (1, "nothing here"), (None, "a DiGA app"), (None, "plain"), (2, "on GLP-1 now"), (3, None), (4, ""), (5, "a \u00b5 sign")],
        "k int, text string")
    terms = spark.createDataFrame([("sepsis",), ("diga",), ("GLP-1",), ("\u00b5",), ("",), (None,)], "term string")
    kept = sorted((r.k or 0, r.text or "") for r in P.leak_screen(prompts, terms).collect())
    assert kept == [(0, "plain"), (1, "nothing here"), (3, ""), (4, "")]
    assert P.leak_screen(prompts, terms.limit(0)).count() == 8
