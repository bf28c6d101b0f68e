import random

import pytest

from corpus_text import prose


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, edited copies in chains, shared passages, nulls, empty and white texts, repeated rows, no id."""
    rng = random.Random(5)
    rows, at = [], 0

    def put(text, id="next"):
        nonlocal at
        rows.append((at if id == "next" else id, text))
        at += 1

    for t in (None, "", " \n\t", "x", "One", "two words", "two  Words\n", "a\x0bb", "a b c d", "ÀÉ àé", "日本 語 テスト " * 30):
        put(t)
    passage = prose(rng, 120)
    for k in range(12):
        put(prose(rng, 60) + "\n" + passage + " " + prose(rng, 40 + k))
    for _ in range(25):
        base = prose(rng, rng.choice([8, 30, 120, 400]))
        put(base)
        for _ in range(rng.randint(0, 4)):
            words = base.split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = prose(rng, 1)
            put((" " if rng.random() < .5 else "\n").join(words))
            if rng.random() < .5:
                base = " ".join(words)
    family = prose(rng, 80).split()
    for k in range(60):
        words = list(family)
        words[k] = "edit%d" % k
        put(" ".join(words))
    put("ab" * 3000)
    put("la " * 4000)
    put(prose(rng, 9000))
    rows += [rows[15], rows[15], (None, rows[20][1]), (None, "text without an id here"), (None, None), (7, "another text of id seven")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, f"s{k % 3}" if k % 7 else None, k, "x", 1.5) for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, digest string, score double").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
