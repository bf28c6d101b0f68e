"""Ranked search against brute force: ties, repeats, nulls, several shards and blocks."""

import math
import random
import re
from collections import Counter

import pytest

from corpus_text import prose

from ledgerloom.llm import search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k):
    tf = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for i, t in items:
        scores = []
        for (d, _), c, x in zip(docs, tf, n):
            m = x and 100 - 25 + 25 * x * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[q] + 1))) * (1000000000 * c[q] // (1000 * c[q] + 12 * m))
                    for q in terms(t) if c[q])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(8)
    some = [t for _, t in corpus if t and len(t) < 2000][:12]
    return ([(k, " ".join(t.split()[:25])) for k, t in enumerate(some)]
            + [(50, prose(rng, 5)), (51, "an an an be be la"), (52, None), (53, ""), (54, "nothingknown"), (None, "an be"), (50, "日本 語 ÀÉ"),
               (50, "an be")])


def held(docs, items):
    rows = docs.sparkSession.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    return rows


@pytest.mark.parametrize("k", [1, 3, 20, 1000])
@pytest.mark.parametrize("size", [1 << 16, 7])
def test_search(docs, corpus, items, k, size, monkeypatch):
    monkeypatch.setattr(search, "DOCS", size)
    got = search.search(docs, held(docs, items), k=k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(tuple(r) for r in got.collect()) == brute(corpus, items, k)


def test_blocks_and_long_texts(docs, corpus, items, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 50)
    got = search.search(docs, held(docs, items), k=5, block=200)
    assert Counter(tuple(r) for r in got.collect()) == brute(corpus, items, 5)


def test_ties(spark):
    docs = [(k, "one two") for k in range(30, 0, -1)] + [(7, "one two")]
    df = spark.createDataFrame(docs + [(99, "three")], "doc_id long, text string").repartition(4)
    got = search.search(df, held(df, [(1, "two one")]), k=20).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in docs)[:20]


def test_empty(docs, none, items):
    asked = held(docs, items)
    assert search.search(none, asked).count() == 0
    assert search.search(docs, asked.limit(0)).count() == 0


def test_pruning_is_exact_and_happens():
    """Accumulators stop early on random shards, and no document of the first k is lost."""
    import numpy as np
    rng = random.Random(3)
    for trial in range(60):
        docs = rng.randrange(1, 300)
        lists = [sorted(rng.sample(range(docs), max(1, int(docs * rng.random() ** 3)))) for _ in range(12)]
        per = [[(t, rng.randrange(1, 5)) for t, x in enumerate(lists) if d in set(x)] for d in range(docs)]
        shard = search.Shard(list(range(docs)), [rng.randrange(1, 50) for _ in range(docs)],
                             np.array([t for x in per for t, _ in x], np.int32), np.array([c for x in per for _, c in x], np.int64),
                             np.array([len(x) for x in per]), (docs, docs * 20), 12, 25)
        item = sorted(((t, max(1, int(3000 * math.log((docs + 1) / len(lists[t]))))) for t in rng.sample(range(12), 8)), key=lambda x: -x[1])
        full = np.zeros(docs, np.int64)
        for t, w in item:
            a, z, _ = shard.at[t]
            full[shard.doc[a:z]] += w * shard.gain[a:z]
        k = rng.choice([1, 2, 10])
        best = sorted(full[full > 0].tolist(), reverse=True)
        floor = rng.choice([0, best[0] // 2])
        got, scores = shard.best(item, k, floor)
        assert (full[got] == scores).all()
        kth = max(best[min(k, len(best)) - 1], floor)
        assert set(got.tolist()) == {d for d in range(docs) if full[d] >= max(1, kth)}
