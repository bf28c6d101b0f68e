"""Tokenizer operators: against the libraries, and exact round trips."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, chat, token_counts, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    tokens, table = bpe.vocabulary(RANKS)
    entries = [t for t in tokens if t]
    assert table.slots(entries).tolist() == list(range(len(entries)))
    assert len(set(table.slots([b"%d-" % i for i in range(5000)]).tolist())) > 4000


def test_bpe_rows(docs, corpus, none, library):
    got = {(r["doc_id"], r["text"]): r for r in bpe.encode(docs, RANKS, P.PATTERN, ["doc_id", "text"], digests=True).collect()}
    for (i, t), r in got.items():
        ids = library.encode_ordinary(t or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert set(got) == set(corpus)
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, ["text"]), RANKS, ["text"]).collect()
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back)
    assert bpe.encode(none, RANKS, P.PATTERN, ["doc_id"]).count() == 0


def test_bpe_long_and_odd(library):
    c = bpe.Codec(*bpe.vocabulary(RANKS), P.PATTERN)
    rng = random.Random(2)
    odd = "".join(rng.choice(["ab", " ", "\n", "  ", "é", "1", "'s", "日本", "a" * 30, " ", "\x1c"]) for _ in range(120_000))
    assert len(odd) > bpe.LONG
    for t in (odd, "a" * 50_000, " " * 3000 + "x", "\U0001f600" * 50):
        assert [i for part in c.encode(t) for i in part] == library.encode_ordinary(t)


def test_code_lengths():
    rng = np.random.default_rng(4)
    for n, limit in ((1, 16), (2, 16), (7, 16), (300, 10), (5000, 16)):
        counts = np.maximum(1, (1e9 / (1 + np.arange(n)) ** 3).astype(np.int64))
        rng.shuffle(counts)
        bits = token_files.code_lengths(counts, limit)
        assert bits.max() <= limit and (n == 1 or abs((0.5 ** bits).sum() - 1) < 1e-12)
    import heapq
    heap = [(int(c), 0) for c in counts[:200]]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 0))
    assert (token_files.code_lengths(counts[:200], 40) * counts[:200]).sum() == cost


def test_code_round_trip(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 256)
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.3, n) % 3000 for n in (1, 63, 64, 65, 1, 256, 257, 5000, 2)]
    ids = np.concatenate(docs)
    seen, n = np.unique(ids, return_counts=True)
    for limit in (12, 20):
        code = token_files.Code(seen, token_files.code_lengths(n, limit))
        packed = code.encode(ids, np.array([len(d) for d in docs]))
        back = code.decode(*(list(x) for x in zip(*packed)), np.array([len(d) for d in docs]))
        assert all((a == b).all() for a, b in zip(docs, back))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, docs, corpus, none, tmp_path, file):
    path, lib = P.path(file), Tokenizer.from_file(P.path(file))
    assert token_files.Ids(path).word_wise == (file == "word_bpe_49k.json")
    more = spark.createDataFrame([(900, "ÀÉ Straße, İstanbul; ẖi ΣΑΣ é x<|endoftext|>y <|ENDOFTEXT|> 'S can'T a.b, c)."), (901, "\x1c\x85 a")],
                                 "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    token_files.write(both, path, str(tmp_path / "a"), end=2)
    rows = token_files.read(spark, str(tmp_path / "a")).collect()
    assert len(rows) == both.count()
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in both.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    before = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == before and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        before += r["n_tokens"]
    named = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert named == sorted(named)
    token_files.write(none, path, str(tmp_path / "b"), end=2)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_token_counts(docs, corpus, none):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False))
    got = Counter(tuple(r) for r in token_counts.counts(docs, path, ["doc_id"]).collect())
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 512) for i, t in corpus)
    assert token_counts.counts(none, path, ["doc_id"]).count() == 0
    rng = random.Random(3)
    odd = "".join(rng.choice(["ab", " ", "  ", "\n", " 's", "'s", "<|endoftext|>", " é", "　", "12"]) for _ in range(20_000))
    cut = token_counts.split(odd, 50)
    assert "".join(cut) == odd and len(cut) > 100 and sum(map(n, cut)) == n(odd)


def test_chat(spark, tmp_path):
    rng = random.Random(6)
    say = lambda: "".join(rng.choice(["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|im_sep|>", " ", "\n", "hi", "é", "\U0001f600", "<|endoftext|>"])
                          for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", None, "a\nb", "<|im_sep|>"]), rng.choice([None, "", say(), say(), say()]), 1)
            for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", say() * 40, 1) for t in range(400)] + [(None, 1, "assistant", "x", 1), rows[0]]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int").repartition(7)
    parts = chat.format_parts(turns, P.path("byte_bpe_50k.json"))
    whole = parts.collect()
    assert sum(r["conv_id"] == 77 for r in whole) > 1
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault(c, []).append((t, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        said = "".join(x for _, role, x in g if role == "assistant")
        assert got[c]["n_turns"] == len(g)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in g).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(r["formatted"]) for r in whole if r["conv_id"] == c)
    assert chat.read_back(chat.format_parts(turns.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


def test_plain_keeps_ids():
    lib, rng = Tokenizer.from_file(P.path("word_bpe_49k.json")), random.Random(9)
    signs = [chr(c) for c in range(0x130) if c != 0x130] + [". ", ", ", ".\n", "...", "'s ", "'S", "_.", "<|endoftext|>", "<|EndOfText|>", "Word", "é", "12"] * 8
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 12)))
        assert lib.encode(token_files.plain(t), add_special_tokens=False).ids == lib.encode(t, add_special_tokens=False).ids, repr(t)


def encoded(ids, texts):
    """Ids of texts encoded side by side, as one piece of a batch."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return [np.frombuffer(x, ids.kind).tolist() for x in ids.whole(pa.array(texts), data, np.cumsum([0] + [len(x) for x in raw]))]


def test_words_side_by_side():
    """Words meet marks, digits, apostrophes, composing characters and special strings, in texts that touch."""
    ids, rng = token_files.Ids(P.path("word_bpe_49k.json")), random.Random(4)
    signs = ["'", "'s", "'LL", "'d", "J", "J\u030c", "\u0301", "<", "<\u0338", "<|", "<|endoftext|>", "ΑΣ", "İ", "ß", "É", "×", "÷", "ÿ", "Þ", "µ", "ª", "²", "\u00a0", "\u0085",
             "\u2028", "\x1c", "\x0b", "\x00", " ", " ", "\n", "日本", "\U0001f600", "—", "ŉ", "Don", "we", "3rd", "20", "٣", "_", ".", ",", "-", "(", "ab", "Cd"]
    texts = ["", "\n", "x"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    want = [e.ids for e in ids.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert [(t, g) for t, g, w in zip(texts, encoded(ids, texts), want) if g != w] == []
    assert encoded(ids, ["", " "]) == [[], []] and encoded(ids, []) == []


def test_words_remembered_once(monkeypatch):
    """Case, marks and brackets around a word make no other word to encode, and what is forgotten is encoded again."""
    ids = token_files.Ids(P.path("word_bpe_49k.json"))
    texts = ["Word, (WORD) word-word; word's", "Élan élan. (ÉLAN), word2019word"]
    want = [ids.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(ids, texts) == want
    letters = {w.decode() for w in ids.young if w.decode().isalpha()}
    assert letters == {"word", "élan"} and len(ids.young) < 16
    monkeypatch.setattr(token_files, "KEPT", 4)
    for _ in range(4):
        assert encoded(ids, texts) == want and encoded(ids, ["other words here now again"]) == [
            ids.tok.encode("other words here now again", add_special_tokens=False).ids]
        assert not ids.young


@pytest.mark.parametrize("name", ["_body", "body_", "score", "ids"])
def test_columns_of_any_name(docs, name):
    """Columns that the operators could use themselves stay as they are."""
    from ledgerloom.llm import quality, toxicity

    more = docs.select("doc_id", "text", "n").withColumnRenamed("n", name)
    columns = ["doc_id", name]
    assert bpe.encode(more, RANKS, P.PATTERN, columns, ids=name != "ids", digests=True).columns[:2] == columns
    got = token_counts.counts(more, P.path("byte_bpe_50k.json"), columns).collect()
    assert Counter((r["doc_id"], r[name]) for r in got) == Counter((r["doc_id"], r["n"]) for r in docs.select("doc_id", "n").collect())
    if name != "score":
        assert quality.scores(more, None, columns).where("score = 0").count() == docs.count()
        assert toxicity.scores(more, None, columns).where("score = 0").count() == docs.count()
