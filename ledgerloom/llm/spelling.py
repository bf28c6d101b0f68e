"""Spelling variants: words one edit apart, found by composing acceptors, and the form that each variant stands for.

Words are runs of Latin letters (`[A-Za-z\\u00C0-\\u00FF]+`, A-Z as a-z), counted over whole texts with partial sums a task.
Two words are near when one inserted, deleted or replaced code point parts them. For that the vocabulary's acceptor is
composed with a one-edit transducer and with itself: a path reads equal letters from one state on, takes one edit where the
words first differ, and reads equal letters again until both accept. Taking the edit at the first difference only
makes the transducer unambiguous, so that each pair comes once.

The composition is parted by where a path begins: words of s and s + 1 letters that first differ in [lo, hi) share lo letters
in front and s - hi at the end, so the words between those ends, from the state behind the front, are a vocabulary of their
own. A range is halved at first, and again wherever a part holds more than LIMIT words; at one position a part is bounded by
the alphabet. Each part's minimised acceptor is built in a task, one at a time, and enumerated.

A word's form is its near word of the largest count (ties: smallest in code-point order) if that is at least twice its own;
the root follows forms to the last. Counts at least double with each step, so paths are short; they are halved
by joins. Null texts count as none, a null id edits as the empty one; rows that repeat count again. Empty tables
give no rows. Only the named columns are read. Memory of a task: FLUSH different words, or the words of one part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import byte_bound, cut

LIMIT, FLUSH, CHUNK, ROWS = 4096, 200_000, 1 << 20, 1 << 16
SHORTEST, RAREST, EDITED = 5, 3, 97
#: Latin-1 bytes of letters stay (A-Z as a-z), all others part words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
PART = ["s", "lo", "hi", "front", "back"]


def runs_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in Latin-1, some at a time."""
    text, at = text.encode("latin-1", "replace").translate(_LETTERS), 0
    while at < len(text):
        to = len(text) if len(text) - at <= CHUNK else text.find(b" ", at + CHUNK)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def edited(run: bytes, seed: int, every: int) -> bytes:
    """The run, without one letter where `every` divides its checksum behind the document's."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, every: int | None = EDITED,
               text: str = "text", id: str = "doc_id") -> DataFrame:
    """word, n: words of at least `shortest` letters and `rarest` occurrences; every=None counts runs as they are."""
    byte_bound(docs.sparkSession)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.record_batch([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for some in runs_of(body):
                    for run, c in Counter(some).items():
                        if len(run) < shortest:
                            continue
                        word = edited(run, seed, every) if every else run
                        if len(word) >= shortest:
                            total[word] += c
                    if len(total) >= FLUSH:
                        yield flushed()
                        total.clear()
        yield flushed()

    body = docs.select(F.col(id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return body.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


class Acceptor:
    """Minimised acceptor of some words in ascending order: state 0 is the start."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # open states of the last word: parent, letter, state

        def close(depth: int) -> None:
            while len(path) > depth:
                parent, letter, state = path.pop()
                same = known.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
                if same != state:
                    self.arcs[parent][letter] = same
        last = ""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            state = path[-1][2] if path else 0
            for letter in word[common:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[state][letter] = new = len(self.arcs) - 1
                path.append((state, letter, new))
                state = new
            self.final[state] = True
            last = word
        close(0)

    def both(self, p: int, q: int, letters: int, but: str = "") -> Iterator[str]:
        """Words of so many letters that two states accept, the first letter none of `but`."""
        todo = [(p, q, letters, "", but)]
        while todo:
            p, q, letters, read, but = todo.pop()
            if not letters:
                if self.final[p] and self.final[q]:
                    yield read
                continue
            a, b = self.arcs[p], self.arcs[q]
            if len(b) < len(a):
                a, b, p_first = b, a, False
            else:
                p_first = True
            for x, to in a.items():
                if x != but and (other := b.get(x)) is not None:
                    todo.append((to, other, letters - 1, read + x, "") if p_first else (other, to, letters - 1, read + x, ""))

    def one_edit(self, letters: int, depth: int) -> Iterator[tuple[str, str]]:
        """Pairs of accepted words, of `letters` and of `letters` or one more, that first differ before `depth`."""
        todo = [(0, "")]
        while todo:
            state, read = todo.pop()
            at = len(read)
            arcs = list(self.arcs[state].items())
            for k, (y, q) in enumerate(arcs):
                for rest in self.both(state, q, letters - at, y):  # y inserted
                    yield read + rest, read + y + rest
                if at < letters:
                    for x, p in arcs[:k]:  # x replaced
                        for rest in self.both(p, q, letters - at - 1):
                            yield read + x + rest, read + y + rest
                if at + 1 < depth and at < letters:
                    todo.append((q, read + y))


def halved(rows: DataFrame) -> DataFrame:
    """Rows of a part (word, n and PART) as rows of the two parts of half its range."""
    mid = F.expr("(lo + hi) div 2")
    range_ = F.explode(F.array(F.struct(F.col("lo").alias("from"), mid.alias("to")), F.struct(mid.alias("from"), F.col("hi").alias("to"))))
    parts = rows.select("word", "n", "s", range_.alias("r")).where("r.from < r.to")
    return parts.select("word", "n", "s", F.col("r.from").alias("lo"), F.col("r.to").alias("hi"),
                        F.expr("left(word, r.from)").alias("front"), F.expr("right(word, greatest(s - r.to, 0))").alias("back"))


def near_pairs(vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n: both directions of every pair of near words."""
    byte_bound(vocab.sparkSession)
    long = F.char_length("word")
    rows = halved(vocab.select("word", "n", F.explode(F.array(long, long - 1)).alias("s")).where("s > 0")
                  .withColumns({"lo": F.lit(0), "hi": F.col("s") + 1}))
    small = None
    while True:
        large = cut(rows.groupBy(PART).count().where((F.col("count") > limit) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "large")
        ready = rows if large.isEmpty() else rows.join(large, PART, "left_anti")
        small = ready if small is None else small.unionByName(ready)
        if ready is rows:
            break
        rows = cut(halved(rows.join(large, PART, "left_semi")), "halved")

    def composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, words = None, {}

        def pairs():
            if len(words) < 2:
                return
            s, lo, hi, front, back = key
            n = {w[lo:len(w) - len(back)]: (w, c) for w, c in words.items()}
            for u, v in Acceptor(sorted(n)).one_edit(s - lo - len(back), hi - lo):
                (a, i), (b, j) = n[u], n[v]
                yield a, b, j
                yield b, a, i

        def flushed():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[], [], []], [pa.string(), pa.string(), pa.int64()])],
                                   ["word", "near", "near_n"])
        for batch in batches:
            for word, n, *at in zip(*(batch.column(c).to_pylist() for c in ("word", "n", *PART))):
                if at != key:
                    for pair in pairs():
                        out.append(pair)
                        if len(out) >= ROWS:
                            yield flushed()
                            out.clear()
                    key, words = at, {}
                words[word] = n
        for pair in pairs():
            out.append(pair)
            if len(out) >= ROWS:
                yield flushed()
                out.clear()
        yield flushed()

    dealt = small.repartition(*PART).sortWithinPartitions(*PART)
    return dealt.mapInArrow(composed, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: (word, form) followed to the last form; counts rise along forms, so there is no circle."""
    held = cut(forms, "forms")
    while True:
        on = held.select(F.col("word").alias("form"), F.col("form").alias("next"))
        held = cut(held.select("word", "form").join(on, "form", "left").select(
            "word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")), "forms")
        if held.where("moved").isEmpty():
            return held.select("word", F.col("form").alias("root"))


def variants(vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    vocab = cut(vocab, "vocabulary")
    best = near_pairs(vocab, limit).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("back"), F.col("near"))).alias("best"))
    takes = -F.col("best.back") >= 2 * F.col("n")
    known = cut(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"),
        F.when(takes, -F.col("best.back")).alias("form_n")), "near")
    found = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
