"""Learnt scores: gradients, held-out accuracy, defined results for odd rows."""

import random

import numpy as np
from corpus_text import prose

from ledgerloom.llm import quality, toxicity


def test_gradients():
    rng = np.random.default_rng(1)
    m = toxicity.Model(rng)
    x = rng.standard_normal((7, 3, 2 + 2 * toxicity.VEC))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    on = (np.arange(7)[:, None] < np.array([7, 4, 2])).astype(np.float32)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = toxicity.sigmoid(toxicity.forward(m, toxicity.products(m, x), on))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    g, dx = toxicity.gradients(m, x, on, y)
    for k in ("Wf", "Uf", "Wb", "Ub", "bf", "att", "ask", "out", "bias"):
        at = tuple(rng.integers(0, s) for s in m.p[k].shape)
        m.p[k][at] += 1e-3
        up = loss()
        m.p[k][at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - g[k][at]) < 2e-3
        m.p[k][at] += 1e-3


def labelled(n, seed):
    rng = random.Random(seed)
    texts, y = [], []
    for k in range(n):
        words = prose(rng, rng.randint(5, 300)).split()
        if k % 4 == 0:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "vermin", "grub" + prose(rng, 1)])
        texts.append(" ".join(words))
        y.append(int(k % 4 == 0))
    return texts, np.array(y)


def test_toxicity_accuracy():
    m = toxicity.train(*labelled(800, 1))
    texts, y = labelled(400, 2)
    hit = (toxicity.score(m, texts) >= 0.3).astype(int) == y
    assert hit.mean() > 0.95
    # A text's score depends on no neighbour, and covers its end.
    assert abs(toxicity.score(m, texts[:1])[0] - toxicity.score(m, texts[3:4] + texts[:1])[1]) < 1e-6
    far = prose(random.Random(3), 3000)
    assert toxicity.score(m, [far + " vermin scoundrel vermin"])[0] > toxicity.score(m, [far])[0]


def test_toxicity_rows(docs, none):
    m = toxicity.train(*labelled(100, 1))
    got = toxicity.scores(docs, m, ["doc_id", "text", "n"]).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if not (r["text"] or "").strip())
    assert toxicity.scores(none, m, ["doc_id"]).count() == 0
    assert toxicity.train(["a", "b"], np.array([0, 0])) is None
    assert {r["score"] for r in toxicity.scores(docs, None, ["doc_id"]).collect()} == {0.0}


def test_toxicity_fit_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels) is None


def test_quality(spark, docs, none):
    rng = random.Random(8)

    def text(good):
        words = prose(rng, rng.randint(10, 200)).split()
        return " ".join(words if good else [w.upper() + "!!" for w in words] if rng.random() < .5 else [w for w in words for _ in range(4)])
    train = [(text(k % 3), int(k % 3 > 0)) for k in range(400)]
    v = quality.Voters(*zip(*train))
    test = [(text(k % 3), int(k % 3 > 0)) for k in range(200)]
    score = v.score(*quality._joined([t.encode() for t, _ in test]))
    assert ((score >= 0.3) == np.array([y for _, y in test])).mean() > 0.95
    # Blocked products choose the same neighbours as one text at a time.
    one = [v.score(*quality._joined([t.encode()]))[0] for t, _ in test]
    assert np.allclose(score, one, atol=1e-4)
    got = quality.scores(docs, v, ["doc_id", "text"]).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if not (r["text"] or "").strip())
    assert quality.scores(none, v, ["doc_id"]).count() == 0
    assert {r["score"] for r in quality.scores(docs, None, ["doc_id"]).collect()} == {0.0}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    assert len(quality.fit(docs, labels).labels) > 10 and quality.fit(docs, labels.limit(0)) is None
