"""Shortest edit scripts against plain dynamic programming."""

import random
import re

import pytest

from ledgerloom.functions import alignment as A
from ledgerloom.operators import pairs as D


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("rows", [1, 40, 1 << 28])
def test_common_is_longest(monkeypatch, rows):
    monkeypatch.setattr(A, "ROWS", rows)
    rng = random.Random(rows)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(40))] for _ in range(2))
        got = A.common(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert A.common([], [1]) == A.common([1], []) == []


def test_long_pairs():
    rng = random.Random(1)
    a = [rng.randrange(3000) for _ in range(20_000)]
    b = [x for x in a if rng.random() > 0.01]
    assert len(A.common(a, b)) == len(b)


def test_edits_at_both_ends_leave_the_middle(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [("ends", " ".join(["new"] + words[1:-1] + ["modeled at"]), " ".join(words)), ("same", "a b", "a  b"), ("null", None, "x"), ("both", None, None)]
    got = {r.id: r for r in D.diagnose_pairs(spark.createDataFrame(rows, "id string, chosen string, rejected string"), {"m": ["modeled at"]}, ["id"]).collect()}
    assert got["ends"].differing == 5 / 101 and abs(got["ends"].off_feature - 2 / 5) < 1e-9
    assert (got["same"].differing, got["null"].differing, got["both"].differing) == (0.0, 1.0, 0.0)


def test_a_side_that_holds_the_other_needs_no_rows(monkeypatch):
    """Words replaced by words of one side only, wherever they are: no row of bits is made, and the pairs are those of the rows."""
    rng = random.Random(3)
    made = []
    rows = A._advanced
    monkeypatch.setattr(A, "_advanced", lambda *a: made.append(a) or rows(*a))
    for n in (8, 65, 400, 3000):
        a = [f"w{rng.randrange(n // 4)}" for _ in range(n)]
        for b in ([f"new{i}" if i in (1, n // 2, n - 2) else x for i, x in enumerate(a)], [x for x in a if rng.random() > 0.02]):
            for x, y in ((a, b), (b, a)):
                got = A.common(x, y)
                assert all(x[i] == y[j] for i, j in got) and len(got) == (longest(x, y) if n < 1000 else sum(w in set(a) for w in b))
                assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert not made
    # as the way back through the rows has it: each word as early as the other side has it
    assert A.common(list("xababz"), list("yabq")) == [(1, 1), (2, 2)] and A.common(list("yabq"), list("xababz")) == [(1, 1), (2, 2)]


def test_offsets_of_words_that_differ():
    """Offsets count characters and words end at any white space, as a search for words gives them."""
    rng = random.Random(4)
    for alphabet in ("ab \n", "abé 　 \x1c", "a\U0001f600漢 \t"):
        for _ in range(300):
            a, b = ("".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2))
            got, x, y = A._compared(a, b), list(re.finditer(r"\S+", a)), list(re.finditer(r"\S+", b))
            pairs = A.common([m[0] for m in x], [m[0] for m in y])
            for side, words, kept in (("a", x, {i for i, _ in pairs}), ("b", y, {j for _, j in pairs})):
                assert got[side] == [{"start": m.start(), "end": m.end()} for k, m in enumerate(words) if k not in kept]
            assert got["words"] == len(x) + len(y)
