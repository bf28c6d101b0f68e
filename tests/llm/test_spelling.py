"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def vocabulary(rows, every=97):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def variants(n):
    form, out = {}, Counter()
    for w in n:
        some = [x for x in n if near(w, x)]
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = (best if best and n[best] >= 2 * n[w] else None, len(some))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out[(w, form[w][0], root, n[w], form[w][1], n.get(form[w][0]))] += 1
    return out


def test_documents(docs, corpus):
    got = spelling.variants(spelling.vocabulary(docs, every=5))
    assert Counter(tuple(r) for r in got.collect()) == variants(vocabulary(corpus, 5))
    assert Counter(tuple(r) for r in spelling.vocabulary(docs).collect()) == Counter(vocabulary(corpus).items())


def test_long_texts_and_flushes(docs, corpus, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 40)
    monkeypatch.setattr(spelling, "FLUSH", 3)
    assert Counter(tuple(r) for r in spelling.vocabulary(docs).collect()) == Counter(vocabulary(corpus).items())


@pytest.mark.parametrize("limit", [2, 10, 4096])
def test_vocabularies(spark, limit):
    rng = random.Random(limit)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"x" * 300, "x" * 299, "x" * 299 + "y"}
    n = {w: 2 ** rng.randrange(9) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = spelling.variants(df, limit=limit)
    assert Counter(tuple(r) for r in got.collect()) == variants(n)


def test_empty(docs, none, spark):
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
    one = spark.createDataFrame([(None, "Word words WORD word", 1), (1, None, 2)], "doc_id long, text string, n int")
    got = spelling.variants(spelling.vocabulary(one, shortest=4, every=None)).collect()
    assert [tuple(r) for r in got] == [("word", None, "word", 3, 0, None)]


def test_acceptor_is_minimal():
    words = sorted({a + b for a in ("walk", "talk", "x") for b in ("", "s", "ed", "ing")})
    made = spelling.Acceptor(words)
    reach, todo = {0}, [0]
    while todo:
        for q in made.arcs[todo.pop()].values():
            if q not in reach:
                reach.add(q)
                todo.append(q)

    def language(p):
        return frozenset([""] if made.final[p] else []) | {x + r for x, q in made.arcs[p].items() for r in language(q)}
    assert language(0) == set(words)
    assert len({language(p) for p in reach}) == len(reach)
