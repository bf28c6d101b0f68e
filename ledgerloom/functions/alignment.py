"""What differs between two texts, in words, by a shortest edit script.

The words that stay are a longest common subsequence. Its length for every beginning of one side is a row of bits, worked on
as one integer per word of the other side, so a pair costs words times words / 64. Rows are kept to find the way back
while they fit into ROWS bits; longer pairs are halved at the place where beginnings and ends fit best, which needs two
rows only. Equal beginnings and ends are set aside first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress, count
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = 1 << 28
#: Whether a character is white space, by its code; none above U+3000 is.
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def _advanced(a: Sequence, b: Sequence, keep: bool) -> list[int]:
    """Rows of bits (0 where the common length grows) behind each word of a, or the last one."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        if hit:
            row = (row + hit | row - hit) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _growth(row: int, n: int) -> np.ndarray:
    """Common length with the first 0, 1, ..., n words of the other side."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _equal(a: Iterable, b: Iterable, n: int) -> int:
    """How many of the first n elements of both are equal before one differs."""
    return next(compress(count(), map(ne, a, b)), n)


#: Words that a run is first compared over.
STRIDE = 64


def _leftmost(a: Sequence, b: Sequence) -> list[tuple[int, int, int]] | None:
    """Runs by which one side's words stand in the other in order, each word as early as it can; None where neither holds the other.

    The way back through the rows takes the same places.
    """
    few, many = (a, b) if len(a) < len(b) else (b, a)
    runs, p, q = [], 0, 0
    while q < len(few):
        try:
            p = many.index(few[q], p)
        except ValueError:
            return None
        n, step = 1, STRIDE
        while True:
            x, y = many[p + n:p + n + step], few[q + n:q + n + step]
            if not y or x != y:
                break
            n, step = n + step, 2 * step
        n = min(n + _equal(x, y, min(len(x), len(y))), len(few) - q)
        runs.append((q, p, n) if few is a else (p, q, n))
        p, q = p + n, q + n
    return runs


def _placed(at_x: Sequence[int], at_y: Sequence[int], n: int) -> Iterator[tuple[int, int, int]]:
    """A run of words picked from both sides as the runs that it is there."""
    if at_x[-1] - at_x[0] == n - 1 and at_y[-1] - at_y[0] == n - 1:
        yield at_x[0], at_y[0], n
        return
    yield from _placed(at_x[:n // 2], at_y[:n // 2], n // 2)
    yield from _placed(at_x[n // 2:], at_y[n // 2:], n - n // 2)


def _runs(a: Sequence, b: Sequence) -> Iterator[tuple[int, int, int]]:
    """A longest common subsequence as runs of equal words: their positions and length, in no order."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, to_i, j, to_j = todo.pop()
        x, y = a[i:to_i], b[j:to_j]
        lead = _equal(x, y, min(len(x), len(y)))
        x, y = x[lead:], y[lead:]
        tail = _equal(reversed(x), reversed(y), min(len(x), len(y)))
        if lead:
            yield i, j, lead
        if tail:
            yield to_i - tail, to_j - tail, tail
        i, to_i, j, to_j = i + lead, to_i - tail, j + lead, to_j - tail
        if i == to_i or j == to_j:
            continue
        # words that the other side lacks change no row and no step of the way back
        x, y = a[i:to_i], b[j:to_j]
        here, there = set(x), set(y)
        at_x, at_y = range(i, to_i), range(j, to_j)
        if not here <= there:
            kept = list(map(there.__contains__, x))
            at_x, x = list(compress(at_x, kept)), list(compress(x, kept))
        if not there <= here:
            kept = list(map(here.__contains__, y))
            at_y, y = list(compress(at_y, kept)), list(compress(y, kept))
        held = _leftmost(x, y)
        if held is not None:
            for p, q, n in held:
                yield from _placed(at_x[p:p + n], at_y[q:q + n], n)
            continue
        if len(x) * len(y) > ROWS and len(x) > 1:
            half = len(x) // 2
            front = _growth(_advanced(x[:half], y, False)[0], len(y))
            back = _growth(_advanced(x[half:][::-1], y[::-1], False)[0], len(y))[::-1]
            at = int(np.argmax(front + back))
            cut_i, cut_j = at_x[half], at_y[at] if at < len(y) else to_j
            todo += [(i, cut_i, j, cut_j), (cut_i, to_i, cut_j, to_j)]
            continue
        rows, k, m = _advanced(x, y, True), len(x), len(y)
        while k and m:
            if rows[k - 1] >> (m - 1) & 1:
                m -= 1
                continue
            k -= 1
            if not k or rows[k - 1] >> (m - 1) & 1:
                m -= 1
                yield at_x[k], at_y[m], 1


def common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, in order."""
    return sorted((i + k, j + k) for i, j, n in _runs(a, b) for k in range(n))


def _gone(kept: bytearray) -> Iterator[int]:
    at = kept.find(0)
    while at >= 0:
        yield at
        at = kept.find(0, at + 1)


def _spans(text: str, gone: Sequence[int]) -> list[dict]:
    """Offsets of the words of a text at some places."""
    if not gone:
        return []
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), len(SPACE) - 1)
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = SPACE[codes]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return [{"start": int(edges[2 * k]), "end": int(edges[2 * k + 1])} for k in gone]


def _compared(a: str, b: str) -> dict:
    x, y = a.split(), b.split()
    left, right = bytearray(len(x)), bytearray(len(y))
    for i, j, n in _runs(x, y):
        left[i:i + n] = right[j:j + n] = b"\1" * n
    return {"a": _spans(a, list(_gone(left))), "b": _spans(b, list(_gone(right))), "words": len(x) + len(y), "la": len(a), "lb": len(b)}


def _differing(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_compared(x, y) for x, y in zip(a, b)], columns=["a", "b", "words", "la", "lb"])


def differing(a, b) -> Column:
    """Struct of the words (start, end) only in a, those only in b, the words of both, and the characters of a (la) and of b (lb);
    null texts count as empty."""
    def body(t):
        return F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit(""))
    found = F.pandas_udf(_differing, "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>, words int, la int, lb int")
    return found(body(a), body(b))
