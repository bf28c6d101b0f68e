"""Exact and near deduplication, decontamination: against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from corpus_text import prose

from ledgerloom.llm import decontaminate, exact_dedup, minhash, suffix_dedup

WHITE = "[\x20\x09-\x0d]"


def norm(t):
    return re.sub(WHITE, "", t or "")


@pytest.mark.parametrize("support", [1e-3, 0.02, 0.2])
def test_exact_decisions(docs, corpus, support):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[norm(t)].append((i, t or ""))
    want = []
    for text, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for i, t in rows:
            want.append((i, best[0], len(rows), (i, len(t)) == (best[0], len(best[1])), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.decisions(docs, support).collect()]
    assert Counter(got) == Counter(want)


def test_exact_keep(docs, corpus, none):
    kept = exact_dedup.keep(docs)
    assert kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert Counter(norm(r["text"]) for r in rows) == Counter({norm(t): 1 for _, t in corpus})
    assert exact_dedup.keep(none).count() == 0 and exact_dedup.decisions(none).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def near_brute(corpus, width):
    keys = sorted({(i, t or "") for i, t in corpus}, key=str)
    sets = []
    for _, t in keys:
        w = words(t)
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(keys):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return {key: (len(sets[k]), least.get(root(k)), root(k)) for k, key in enumerate(keys)}


@pytest.mark.parametrize("width", [2, 5])
def test_near(docs, corpus, width, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)  # several blocks even in a small band
    monkeypatch.setattr(minhash, "SMALL", 3 if width == 2 else 32)
    brute = near_brute(corpus, width)
    want = Counter((i, *brute[i, t or ""][:2]) for i, t in corpus)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width).collect())
    assert got == want
    kept = minhash.keep(docs, width)
    assert kept.dtypes == docs.dtypes
    wordy = Counter(brute[r["doc_id"], r["text"] or ""][2] for r in kept.collect() if words(r["text"]))
    assert set(wordy.values()) == {1} and len(wordy) == len({v[2] for (i, t), v in brute.items() if words(t)})
    assert kept.count() - sum(wordy.values()) == sum(not words(t) for _, t in corpus)


def test_near_empty(none):
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep(none).count() == 0


def leaks_brute(corpus, items, t=0.8):
    tok = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    bag = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    found = set()
    for i, text in set(corpus):
        w = tok(text)
        for item, q in items:
            v = tok(q)
            if len(v) < 5 or len(w) < 5:
                continue
            b = bag(v)
            for at in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[at:at + len(v)])
                low, high = sum((a & b).values()), sum((a | b).values())
                if low >= t * high - 1e-9:
                    found.add((i, item))
                    break
    return found


def test_leaks(spark, docs, corpus):
    long = [t.split() for _, t in corpus if t and len(t.split()) > 100]
    edit = lambda w, *at: " ".join("zz" if k in at else x for k, x in enumerate(w))
    items = [(1, " ".join(long[0][10:40])), (2, edit(long[1][20:80], 3)), (3, edit(long[2][5:65], 30)), (4, edit(long[3][5:35], 4, 14, 24)),
             (5, " ".join(long[4][:9]).upper() + "!"), (6, "two words"), (7, None), (8, ""), (9, " ".join(long[0][10:40])), (10, "la " * 50),
             (11, "a b c d zz"), (12, " ".join(long[5][-70:] + ["tail", "end"])), (None, " ".join(long[6][:20]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    want = {(i, -1 if k is None else k) for i, k in leaks_brute(corpus, items)}
    assert got == want and len(want) == 8
    left = decontaminate.clean(docs, bench)
    assert left.dtypes == docs.dtypes
    bad = {(i, t) for i, t in set(corpus) if leaks_brute([(i, t)], items)}
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(r for r in corpus if r not in bad)


@pytest.mark.parametrize("id", [3, None])
def test_leaks_shared_id(spark, id):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 34).split() for _ in range(4))
    other = lambda n: prose(rng, n).split()
    half = a[:26] + other(8)  # two items that share most of a window each, neither of them enough
    rest = other(8) + a[8:]
    items = [(id, " ".join(half)), (id, " ".join(rest)), (id, " ".join(b)), (id, " ".join(b).upper()),
             (id, ", ".join(c)), (id, " ".join(c)), (id, "; ".join(c).title()), (9, " ".join(d))]
    corpus = [(0, " ".join(other(30) + a + other(30))), (1, " ".join(other(30) + b + other(30))),
              (2, " ".join(c + other(30))), (4, " ".join(other(9) + d)), (5, " ".join(other(80)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontaminate.matches(docs, bench).collect()}
    shared = -1 if id is None else id
    assert got == {(1, shared, 1.0), (2, shared, 1.0), (4, 9, 1.0)}
    assert {(i, k) for i, k, _ in got} == {(i, -1 if k is None else k) for i, k in leaks_brute(corpus, items)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {0, 5}


@pytest.mark.parametrize("rows", [1_000_000, 1000, 0])
def test_leaks_filler(spark, rows, monkeypatch):
    """Where the tenth that differs is one repeated word, on the document's side or the item's; with all tables of items
    broadcast, some of them, none."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(12)
    plain = [prose(rng, 400).split() for _ in range(16)]
    filled = [w[:360] + ["la"] * 40 for w in plain]
    far = [w[:340] + ["la"] * 60 for w in plain]
    items = [(k, " ".join(filled[k] if k % 2 else plain[k])) for k in range(16)]
    corpus = [(k, " ".join(plain[k] if k % 2 else filled[k])) for k in range(16)]
    corpus += [(20 + k, " ".join(plain[k] if k % 2 else far[k]) + " " + prose(rng, 9)) for k in range(0, 4)]
    want = leaks_brute(corpus, items)
    assert {(k, k) for k in range(16)} <= want and not {(20, 0), (22, 2)} & want
    got = decontaminate.matches(spark.createDataFrame(corpus, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_leaks_empty(spark, docs, none):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix(docs, corpus, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    raw = [(i, (t or "").encode()) for i, t in corpus]
    seen = Counter(t[s:s + 100] for _, t in raw for s in range(len(t) - 99))
    want = Counter()
    for i, t in raw:
        gone = [False] * len(t)
        for s in range(len(t) - 99):
            if seen[t[s:s + 100]] > 1:
                gone[s:s + 100] = [True] * 100
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(b for b, g in zip(t, gone) if not g)
        want[(i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest())] += 1
    got = Counter(tuple(r) for r in suffix_dedup.cut_out(docs, length=100, gram=16).collect())
    assert got == want
    assert any(w[3] > 1 for w in want) and suffix_dedup.cut_out(none).count() == 0
