"""Offsets of matches and sentences: equal to a search pattern by pattern with the flags that hold for every text."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import pairs

LEX = {"a": [r"\bby\b", r"\bist\b"], "b": [r"\d+", r"licen[sc]e"], "c": [r"\bth\w+tion\b", r"\bK\b", r"\b\w+heit\b"], "d": [r"\bs\w|x\.", r"\baaa"]}
PIECES = ["by", "BY", "bye", "ist", "\u0131st", "\u0130ST", "list", "42", "\u0664\u0665", "licence", "lIcen\u017fe", "thation", "Thistion", "k", "K", "\u212a", "Freiheit", "s1", "\u017fe",
          "x.", "aaa", "aaaa", "é", "a\u0301", "_", "by\u0301", "\U0001f600", " ", "  ", "\n", "\n\n", ". ", "! ", ".\n ", "?\u00a0", "\u2028", ", ", "-"]


def texts():
    rng = random.Random(2)
    plain = [p for p in PIECES if p.isascii()]
    rows = [(i, "".join(rng.choice(plain if i % 2 else PIECES) + rng.choice(["", " "]) for _ in range(rng.randrange(60)))) for i in range(400)]
    return rows + [(-1, None), (-2, ""), (-3, "by"), (-4, ". by. " * 900), (-5, "no such"), (-6, "é by\n" * 700)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(texts(), "id int, t string").cache()


def gaps(t, pattern):
    """Lengths between matches and of the matches, one search each."""
    return F.transform(F.split(t, pattern, -1), lambda x: F.length(x)), F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: F.length(x))


def test_spans_equal_a_search_for_each_pattern(df):
    cols = {f"_{f}{i}": X.let(F.struct(*[c.alias(n) for c, n in zip(gaps("t", X.FLAGS + p), "gm")]), lambda e: e) for f, ps in LEX.items() for i, p in enumerate(ps)}
    for r in df.select("id", "t", X.spans("t", LEX).alias("got"), *[c.alias(n) for n, c in cols.items()]).collect():
        want = []
        for name in cols:
            at = 0
            for k, m in enumerate((r[name].m or []) if r.t is not None else []):
                at += r[name].g[k]
                want.append((at, at + m, name[1]))
                at += m
        assert [tuple(s) for s in r.got] == sorted(want), r.t


def test_sentence_offsets_and_hits(df):
    want = X.let(F.struct(*[c.alias(n) for c, n in zip(gaps(F.coalesce("t", F.lit("")), X.SENTENCE_BREAK), "gm")]), lambda e: e)
    located = df.select("id", "t", X.sentence_offsets("t").alias("got"), want.alias("w"), X.spans("t", LEX).alias("sp"))
    for r in located.withColumns({"hit": pairs.sentences_hit("sp", F.col("got")), "each": pairs.sentence_hits("sp", F.col("got"))}).collect():
        at, so = 0, []
        for g, m in zip(r.w.g, [*r.w.m, 0]):
            so.append((at, at + g))
            at += g + m
        assert [tuple(s) for s in r.got] == [s for s in so if s[1] > s[0]]
        assert r.hit == [s for s, h in zip(r.got, r.each) if h]
        assert [h for h in r.each] == [any(s.start <= p.start < s.end for p in r.sp) for s in r.got]


def test_masks_agree_with_plain_patterns(df):
    bits = [F.when(F.exists(F.array(*[X.has("t", p) for p in ps]), lambda h: h), 1 << i).otherwise(0) for i, ps in enumerate(LEX.values())]
    got = df.select("t", X.families_mask("t", LEX).alias("m"), sum(bits[1:], bits[0]).alias("w")).collect()
    assert all(r.m == r.w for r in got) and len({r.m for r in got}) > 8


def test_a_letter_first_matches_the_same(spark):
    """Over all characters, each in front of a word's rest, alone and inside a word."""
    assert X.led(r"\bby\b") != r"\bby\b"
    for p in (r"\bb|c", r"\bb*y", r"\bb+y", r"by\b", r"\b\w+", r"\bb[(]x|y[)]", r"(?-i)\bby", r"\bb(?i:y)", r"\Qb\E"):
        assert X.led(p) == p
    assert [X.width(p) for p in (r"\bby\b", r"licen[sc]e", r"a b", r"\b", r"b+", r"\d", "[a-c]", "a|b")] == [2, 7, 3, None, None, None, None, None]
    codes = spark.range(1, 0x11000).where("id < 55296 or id > 57343").select(F.expr("decode(encode('', 'UTF-8'), 'UTF-8')").alias("e"), F.col("id"))
    c = codes.select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    t = c.select("c", F.concat(F.col("c"), F.lit("t ")).alias("a"), F.concat(F.lit("x"), F.col("c"), F.lit("t")).alias("b"))
    for x in "abiksz":
        p = rf"\b{x}t\b"
        off = t.select("c", *[(F.col(n).rlike(X.FLAGS + p) != F.col(n).rlike(X.FLAGS + X.led(p))).alias(n) for n in "ab"])
        assert off.where("a or b").count() == 0
