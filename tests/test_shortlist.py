"""Shortlists with hot tokens, and the anchors' filter."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dictation


def brute(texts, phrases, k):
    out = []
    for i, t in texts:
        mine = {w for w in (t or "").split() if len(w) > 3}
        best = sorted((-len(mine & {w for w in p.split() if len(w) > 3}), j) for j, p in phrases)[:k]
        out += [(i, r, j, -o) for r, (o, j) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 5, 20, 1000])
def test_shortlist_with_hot_tokens(spark, hot):
    rng = random.Random(hot)
    common = ["everywhere", "often", "mostly", "frequent"]
    rare = [f"word{i}" for i in range(60)]

    def some(n):
        return " ".join(["everywhere"] + [w for w in common[1:] if rng.random() < 0.5] + rng.sample(rare, n))
    phrases = [(j, some(rng.randrange(0, 4))) for j in range(80)]
    texts = [(i, some(rng.randrange(0, 5))) for i in range(60)] + [(1000, "everywhere"), (1001, ""), (1002, None), (1003, "unknown words only")]
    df = spark.createDataFrame(texts, "i int, text string")
    reg = spark.createDataFrame(phrases, "id int, phrase string")
    got = dictation.shortlist(df, ["i"], "text", reg, k=5, hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(texts, phrases, 5)


def test_one_token_in_every_text_and_phrase_makes_no_pairs(spark):
    reg = spark.range(3000).select("id", F.concat(F.lit("everywhere unique"), F.col("id")).alias("phrase"))
    df = spark.range(3000).select(F.col("id").alias("i"), F.concat(F.lit("everywhere unique"), F.col("id")).alias("text"))
    got = dictation.shortlist(df, ["i"], "text", reg, k=3)
    assert got.where("rank = 1 AND id = i AND overlap = 2").count() == 3000 and got.where("rank > 1 AND overlap = 1").count() == 6000


def test_filter_holds_all_anchors_and_few_others(spark):
    anchors = spark.range(5000).select(F.xxhash64("id").alias("_w"))
    row, bits = dictation.anchor_filter(anchors, 5000)
    assert row.count() == 1 and bits == 1 << 17
    seen = spark.range(10000).select("id", F.xxhash64("id").alias("h")).crossJoin(row).where(dictation._maybe(F.col("h"), bits))
    ids = [r["id"] for r in seen.select("id").collect()]
    assert set(range(5000)) <= set(ids) and len(ids) < 5300
    empty, bits = dictation.anchor_filter(anchors.limit(0), 0)
    assert spark.range(10).select(F.xxhash64("id").alias("h")).crossJoin(empty).where(dictation._maybe(F.col("h"), bits)).count() == 0
