"""Steps that grew faster than their input: same results, and plans without what made them grow."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.detectors import Scored
from ledgerloom.functions import text as X
from ledgerloom.lexicons import NAMED
from ledgerloom.operators import bootstrap, dictation, pairs, probes, provenance
from ledgerloom.sources import ledger


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_classical_draws_packed_and_shuffled(spark, monkeypatch):
    """Statistics sent to the draws give what slots joined to their units give, null groups and statistics included."""
    units = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"), "id", (F.col("id") % 7).alias("x"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("y"))
    got = bootstrap.multinomial_draws(units, ["g"], ["x", "y"], ["id"], draws=12)
    assert "_w#" not in plan(got) and got.count() == 36
    packed = sorted(map(repr, got.collect()))
    monkeypatch.setattr(bootstrap, "PACKED", 0)
    joined = bootstrap.multinomial_draws(units, ["g"], ["x", "y"], ["id"], draws=12)
    assert joined.dtypes == got.dtypes and sorted(map(repr, joined.collect())) == packed
    monkeypatch.setattr(bootstrap, "PACKED", 100)
    one = bootstrap.multinomial_draws(units.where("id < 50 or g is null"), ["g"], ["x", "y"], ["id"], draws=4)
    assert one.where("n = 100").count() == 4 and one.count() == 12


def test_evidence_is_looked_up_once(spark):
    runs = spark.createDataFrame([(1, "we assume that; as of my training " * 30, ["after my training"])], "run_id int, output string, upstream array<string>")
    a = provenance.audit(runs, "epistemic", evidence=True)
    each = a.select("run_id", F.explode_outer("evidence").alias("family", "m")).where(F.col("family").isNotNull())
    assert [r.family for r in each.collect()] == ["modeled"]
    from ledgerloom.plans import load
    assert "size(map_from_entries" not in plan(load()[0]["v1_audit_evidence"](spark, "/root/testdata/sf0.001"))


def test_offsets_carry_no_payload_through_windows(spark):
    """Ids and counts alone are ranked over a twig; repeated ids have places of their own."""
    units = spark.createDataFrame([(3, ["a", "b"]), (1, ["c"]), (3, ["d", "e", "f"]), (2, None), (None, ["g"])], "u int, s array<string>")
    got = ledger.global_offsets(units, "u", F.size("s"))
    assert sorted((r.u, r.s, r.offset) for r in got.collect() if r.s) == [(1, ["c"], 0), (3, ["a", "b"], 1), (3, ["d", "e", "f"], 3)]
    parts = [line for line in plan(got).splitlines() if "hashpartitioning" in line and "_k2" in line]
    assert parts and "_unit" in plan(got)
    window = [line for line in plan(got).splitlines() if "Window" in line and "_k2" in line]
    assert window and not any(re.search(r"\bs#", line) for line in window)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_hits_equal_brute_force(spark, monkeypatch, limit):
    """Phrases of one word to many, cut anywhere, with blanks at their ends and in a row."""
    monkeypatch.setattr(dictation, "BROADCAST_ANCHORS", limit)
    rng = random.Random(5)
    words = ["a", "bb", "the", "other", "läuft", "licence" * 4, "x" * 150 + "needle" + "y" * 40, "", "Zwei\tdrei", "v" * 129]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    cuts = []
    for _ in range(160):
        t = rng.choice(texts)[1]
        at = rng.randrange(len(t) + 1)
        cuts.append(t[at:at + rng.choice([1, 3, 6, 9, 14, 30, 80, 200])])
    reg = list(enumerate([*cuts, "the  other", " a ", "nowhere at all in them", "THE OTHER", "eedle"]))
    want = sorted((k, i) for k, t in texts for i, p in reg if p and p.lower() in t.lower())
    got = dictation.literal_hits(spark.createDataFrame(texts, "k int, t string"), ["k"], "t", spark.createDataFrame(reg, "id int, phrase string"), min_len=1)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_small_registry_shuffles_no_text(spark):
    reg = spark.createDataFrame([(1, "alpha bravo charlie delta echo")], "id int, phrase string")
    texts = spark.range(1000).select("id", F.concat(F.lit("x alpha bravo charlie delta echo "), "id").alias("t")).withColumnRenamed("id", "k")
    hits = dictation.literal_hits(texts, ["k"], "t", reg)
    assert hits.count() == 1000 and not re.search(r"hashpartitioning\(k#", plan(hits))


def test_sentence_hits_by_halving(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        spans = sorted((s := rng.randrange(80), s + rng.randint(1, 9), rng.choice("ab")) for _ in range(rng.randrange(12)))
        ends = sorted(rng.sample(range(90), 2 * rng.randrange(8)))
        rows.append((k, spans, list(zip(ends[::2], ends[1::2]))))
    df = spark.createDataFrame(rows, "k int, sp array<struct<start:int,end:int,family:string>>, so array<struct<start:int,end:int>>")
    got = df.select("k", pairs.sentence_hits("sp", F.col("so")).alias("all"), pairs.sentence_hits("sp", F.col("so"), F.array(F.lit("b"))).alias("b"))
    for r, (_, spans, sents) in zip(got.orderBy("k").collect(), rows):
        assert r.all == [any(a <= s[0] < b for s in spans) for a, b in sents]
        assert r.b == [any(a <= s[0] < b and s[2] == "b" for s in spans) for a, b in sents]


def test_scored_spans_take_no_substrings(spark):
    """A sentence is at hand: taking it from its offsets walks the text from its start."""
    det = Scored({"long": lambda s: F.length(s)}, {"long": 12})
    df = spark.createDataFrame([("Short one. A much longer one.\n\nTiny! Another long sentence.",), (None,)], "t string").select(det.spans("t", F.col("t")).alias("sp"))
    assert "substr" not in plan(df).lower()
    assert [[tuple(s) for s in r.sp] for r in df.collect()] == [[(11, 29, "long"), (37, 59, "long")], []]


def test_every_match_holds_a_needed_literal(spark):
    """Whatever case folding lets match, a text that matches is never passed over."""
    assert X.needed(r"\bth\w+tion\b") == ("tion",) and X.needed(r"(?:ab|cd)+x?e") == ("ab", "cd") and X.needed("ab?c{2}") == ()
    assert X.needed(r"\d+") == X.needed("(?i)abc") == X.needed("ab|c") == X.needed("x*") == ()
    letters = spark.range(32, 0x2FFF).select(F.char(F.lit(65)).alias("x"), F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), "UTF-8"), "UTF-8").alias("c"))
    odd = letters.where(F.col("c").rlike("(?iUd)^[a-z]$") & ~F.lower("c").rlike("^[a-z]$"))
    assert {r.c for r in odd.collect()} <= set(X.ODD_CASES)
    text = "ſourCE: Aſ OF my training, Knowledge cut-off, hypothetıcal; WITH by THİrdtion Licenſe, mit est, low/high case"
    df = spark.createDataFrame([(text,), (text.upper(),), ("nothing",), ("",), (None,)], "t string")
    for lex in NAMED.values():
        plain = [F.coalesce(F.greatest(*[X.has("t", p).cast("int") for p in ps], F.lit(0)) > 0, F.lit(False)) for ps in lex.values()]
        rows = df.select(X.families_mask("t", lex).alias("m"), F.array(*plain).alias("p")).collect()
        assert all(r.m == sum(1 << i for i, p in enumerate(r.p) if p) for r in rows)


def test_mask_of_named_families_is_found_once(spark):
    df = spark.createDataFrame([("by 12 licence",)], "t string").select(X.families("t", "prose").alias("f"))
    assert df.first().f == ["agent", "figure", "licence"] and plan(df).count("copyright") == 2


def test_carriage_normalises_caveats_once(spark):
    runs = spark.createDataFrame([("a", "* Mind  the gap. "), ("a", None), ("a", "none"), ("b", "x")], "arm string, output string")
    cav = spark.createDataFrame([("a", 1, ["* Mind the\ngap.", "Other *", ""]), ("a", 2, ["Mind"]), ("b", 1, [])], "arm string, variant int, sentences array<string>")
    got = probes.carriage(runs, cav, "arm")
    assert [(r.arm, r.runs, r.caveats, r.carried_bare, r.carried_appendix) for r in got.collect()] == [("a", 3, 9, 3, 6)]


def test_classical_interval_has_all_its_draws(spark):
    """The bound query gives the operator's own interval, of its default draws."""
    from ledgerloom.operators import estimators
    from ledgerloom.plans import estimators as plans

    audited = spark.range(60).select(
        "id", F.col("id").alias("run_id"), (F.col("id") % 2).cast("string").alias("condition"), (F.col("id") % 7 == 3).alias("floor_guard"),
        (F.col("id") % 5).alias("supply"), (F.col("id") * 7 % 4).alias("emitted"))
    tables = type("Tables", (), {"audited": lambda self: audited})()
    whole = plans.rounded(estimators.ols_interval_classical(audited, ["condition"], ["run_id"]))
    got = sorted(map(repr, plans.e3_bootstrap_multinomial(tables).collect()))
    assert len(got) == 2 and got == sorted(map(repr, whole.collect()))


@pytest.mark.parametrize("head, start, stop", [("0|7|", 0, 1200), ("3|1999|", 99_990, 100_010), ("-1|12|", 9_999_998, 10_000_003), ("x" * 51, 8, 102), ("", 0, 0)])
def test_digests_side_by_side(monkeypatch, head, start, stop):
    monkeypatch.setattr(bootstrap, "LANES", 500)
    want = [int.from_bytes(hashlib.md5(f"{head}{j}".encode()).digest()[:8], "big") for j in range(start, stop)]
    assert bootstrap.digests(head, start, stop).tolist() == want


@pytest.mark.parametrize("held", [0, 3000, 64 << 20])
def test_slots_are_shared_by_groups(monkeypatch, held):
    monkeypatch.setattr(bootstrap, "SLOTS", 100)
    monkeypatch.setattr(bootstrap, "HELD", held)
    monkeypatch.setattr(bootstrap, "_known", {})
    for n, draw in [(30, 5), (250, 5), (70, 5), (250, 6), (1, 5), (99, 6)]:
        want = [0] * n
        for j in range(n):
            want[(int.from_bytes(hashlib.md5(f"9|{draw}|{j}".encode()).digest()[:8], "big") >> 4) % n] += 1
        assert bootstrap.slot_counts(n, draw, 9).tolist() == want
    assert sum(v.nbytes for v in bootstrap._known.values()) <= held
