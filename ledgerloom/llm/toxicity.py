"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters by two channels: the word itself (hashed) and its characters (hashed four-byte pieces, the mark before the
word included, so that stems count). Each channel gives a trained vector and the log-odds of its pieces in the labelled
sample; for the character channel the largest of the word's pieces. Two gated recurrent layers read a window of words in
both directions, attention pools their states, and a logistic unit scores the pool. Windows of `WINDOW` words start every
`STEP` words and the last ends with the text, so they overlap and cover the whole text; the text's score is its largest.

Training sees at most `PER_CLASS` labelled texts per class, chosen by the hash of their id, each of at most `LONGEST`
bytes: this bounds what the driver holds. Log-odds of a training text leave that text out. Scoring reads every text whole.

Texts without words, and null texts, score 0. Without labels of both classes every text scores 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import factors, fresh, mix, pieces, settled

WINDOW, STEP = 64, 48
HIDDEN, VEC, BUCKETS, STAT = 8, 4, 1 << 12, 1 << 16
PER_CLASS, LONGEST = 1500, 1 << 14
BATCH, DECAY = 128, 2.0
#: Windows that one recurrent step holds.
LANES = 1024

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def features(texts: list[str]):
    """Of the words of all texts: hash, text number, number of pieces; and the hashes of their four-byte pieces, word by word.

    A word's pieces start at the mark before it and at each of its bytes. Texts are kept apart by more blanks than a piece
    holds, so nothing of a text reaches its neighbours.
    """
    low = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" " + b"    ".join(low) + b"    ", np.uint8)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    begin = np.cumsum(sizes + 4) - sizes - 3
    inside = _LETTER[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = flips[::2], flips[1::2]
    clean = np.where(inside, data, 32).astype(np.uint32)
    gram = clean[:-3] | clean[1:-2] << 8 | clean[2:-1] << 16 | clean[3:] << 24
    gram = (gram * np.uint32(0x9E3779B1)) ^ (gram * np.uint32(0x85EBCA6B) >> np.uint32(15))
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), gram[:0]
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    value = (clean[inside].astype(np.uint64) + np.uint64(1)) * factors(int(lens.max()))[pos]
    word = mix(np.add.reduceat(value, first) + lens.astype(np.uint64))
    own = lens + 1
    spot = np.repeat(starts - 1 - np.cumsum(own) + own, own) + np.arange(int(own.sum()))
    return word, np.searchsorted(begin, starts, "right") - 1, own, gram[spot]


def odds(pos, neg, share: float, weight: float = 4.0):
    """Shrunken log-odds of document counts against the class share."""
    return np.log((pos + weight * share) / (neg + weight * (1 - share))) - np.log(share / (1 - share))


def word_slot(word):
    return (word >> np.uint64(20) & np.uint64(STAT - 1)).astype(np.int32)


def gram_slot(gram):
    return (gram >> np.uint32(16)).astype(np.int32)


class Model:
    """Weights of the network and the document counts of both channels; small enough to be sent with a task."""

    def __init__(self, rng: np.random.Generator):
        r = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        d = 2 + 2 * VEC
        self.p = {"word": r(BUCKETS, VEC) * 0.3, "char": r(BUCKETS, VEC) * 0.1, "att": r(2 * HIDDEN, HIDDEN), "ask": r(HIDDEN),
                  "out": r(2 * HIDDEN), "bias": np.full(1, -1.0, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": r(d, 3 * HIDDEN), f"U{way}": r(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.word_odds = self.char_odds = None

    def inputs(self, word, own, gram):
        """Vector of every word, with what training needs to reach its parts."""
        w, c = (word & np.uint64(BUCKETS - 1)).astype(np.int32), (gram & np.uint32(BUCKETS - 1)).astype(np.int32)
        cuts = np.cumsum(own) - own
        chars = np.stack([np.add.reduceat(self.p["char"][:, k][c], cuts) for k in range(VEC)], 1) / np.sqrt(own, dtype=np.float32)[:, None]
        return np.concatenate([
            self.word_odds[word_slot(word)][:, None],
            np.maximum.reduceat(self.char_odds[gram_slot(gram)], cuts)[:, None],
            self.p["word"][w], chars], 1).astype(np.float32), (w, c, cuts)


def windows(count: np.ndarray):
    """First word (counted from the text's first), length and text of every window."""
    n = np.where(count <= WINDOW, 1, 1 + -(-(count - WINDOW) // STEP)) * (count > 0)
    doc = np.repeat(np.arange(len(count)), n)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    at = np.minimum(at, np.maximum(count[doc] - WINDOW, 0))
    return at, np.minimum(count[doc], WINDOW), doc


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def layer(x, on, U, back: bool, keep: list | None = None):
    """States (steps, lanes, HIDDEN) of a gated recurrent layer whose inputs are already multiplied; `on` masks words."""
    T, n, _ = x.shape
    out = np.empty((T, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    H = HIDDEN
    for t in range(T - 1, -1, -1) if back else range(T):
        gate = sigmoid(x[t, :, :2 * H] + h @ U[:, :2 * H])
        z, r = gate[:, :H], gate[:, H:]
        new = np.tanh(x[t, :, 2 * H:] + (r * h) @ U[:, 2 * H:])
        nxt = h + z * (new - h)
        if on is not None:
            nxt *= on[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, new))
        out[t] = h = nxt
    return out


def forward(m: Model, x, on, tape: dict | None = None):
    """Scores of windows from word vectors x (steps, lanes, inputs) or their products with the input weights."""
    p, hid = m.p, []
    for way in "fb":
        kept = None if tape is None else tape.setdefault(way, [])
        hid.append(layer(x[way], on, p[f"U{way}"], way == "b", kept))
    h = np.concatenate(hid, 2)
    a = np.tanh(h @ p["att"])
    e = a @ p["ask"]
    if on is not None:
        e = np.where(on > 0, e, np.float32(-30))
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pool = (h * e[:, :, None]).sum(0)
    logit = pool @ p["out"] + p["bias"]
    if tape is not None:
        tape |= {"h": h, "a": a, "e": e, "pool": pool}
    return logit


def products(m: Model, x):
    return {way: x @ m.p[f"W{way}"] + m.p[f"b{way}"] for way in "fb"}


def score(m: Model, texts: list[str]) -> np.ndarray:
    """Largest window score of every text."""
    out = np.zeros(len(texts), np.float32)
    word, doc, own, gram = features(texts)
    if not len(word):
        return out
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    lead = {k: np.concatenate([v, np.zeros((1, v.shape[1]), np.float32)]) for k, v in
            products(m, m.inputs(word, own, gram)[0]).items()}
    at, size, owner = windows(count)
    at = at + first[owner]
    whole = size == WINDOW
    for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
        group = group[np.argsort(size[group], kind="stable")]
        for i in range(0, len(group), LANES):
            g = group[i:i + LANES]
            step = np.arange(size[g[-1]])[:, None]
            idx = at[g][None, :] + step
            on = None
            if size[g[0]] != size[g[-1]]:
                on = (step < size[g][None, :]).astype(np.float32)
                idx = np.where(on > 0, idx, len(word))
            np.maximum.at(out, owner[g], sigmoid(forward(m, {k: v[idx] for k, v in lead.items()}, on)))
    return out


def gradients(m: Model, x, on, y):
    """Gradients of the mean cross-entropy for the network's weights and for x (steps, lanes, inputs)."""
    p, H, tape = m.p, HIDDEN, {}
    logit = forward(m, products(m, x), on, tape)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    h, a, e, pool = tape["h"], tape["a"], tape["e"], tape["pool"]
    g = {"out": pool.T @ d, "bias": d.sum(keepdims=True)}
    dpool = d[:, None] * p["out"]
    dh = e[:, :, None] * dpool
    de = (h * dpool).sum(2)
    de = e * (de - (e * de).sum(0))
    g["ask"] = np.einsum("tn,tnk->k", de, a)
    da = de[:, :, None] * p["ask"] * (1 - a * a)
    g["att"] = np.einsum("tni,tnk->ik", h, da)
    dh = dh + da @ p["att"].T
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        U, W = p[f"U{way}"], p[f"W{way}"]
        dU, dW, db = np.zeros_like(U), np.zeros_like(W), np.zeros(3 * H, np.float32)
        carry = np.zeros((x.shape[1], H), np.float32)
        for t, prev, z, r, new in reversed(tape[way]):
            up = dh[t, :, k * H:(k + 1) * H] + carry
            if on is not None:
                up = up * on[t][:, None]
            dnew = up * z * (1 - new * new)
            dz = up * (new - prev) * z * (1 - z)
            drh = dnew @ U[:, 2 * H:].T
            dr = drh * prev * r * (1 - r)
            pre = np.concatenate([dz, dr, dnew], 1)
            dU[:, :2 * H] += prev.T @ pre[:, :2 * H]
            dU[:, 2 * H:] += (r * prev).T @ dnew
            dW += x[t].T @ pre
            db += pre.sum(0)
            dx[t] += pre @ W.T
            carry = up * (1 - z) + drh * r + pre[:, :2 * H] @ U[:, :2 * H].T
        g |= {f"U{way}": dU, f"W{way}": dW, f"b{way}": db}
    return g, dx


def train(texts: list[str], labels: np.ndarray, updates: int = 400, seed: int = 0) -> Model | None:
    """Fit the network: a text is as toxic as its most toxic window, so each round takes the window scored highest."""
    y = np.asarray(labels, np.float32)
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    m = Model(rng)
    share, held = float(y.mean()), []
    step = max(1, len(texts) // 64)
    parts = [features(texts[i:i + step]) for i in range(0, len(texts), step)]
    parts = [(w, d + i * step, o, g) for i, (w, d, o, g) in enumerate(parts)]
    if not sum(len(p[0]) for p in parts):
        return None
    count = np.zeros((2, 2, STAT))
    slots = lambda p: ((p[1], word_slot(p[0])), (np.repeat(p[1], p[2]), gram_slot(p[3])))
    for p in parts:
        for channel, (owner, slot) in enumerate(slots(p)):
            d, s = np.divmod(np.unique(owner * STAT + slot), STAT)
            for c in (0, 1):
                count[channel, c] += np.bincount(s[y[d] == c], minlength=STAT)
    m.word_odds, m.char_odds = (np.where(neg + pos >= 2, odds(pos, neg, share), 0).astype(np.float32) for neg, pos in count)
    for p in parts:
        left = []  # log-odds without the text itself
        for (owner, slot), (neg, pos) in zip(slots(p), count):
            v = odds(pos[slot] - y[owner], neg[slot] - 1 + y[owner], share)
            left.append(np.where(pos[slot] + neg[slot] >= 3, v, 0).astype(np.float32))
        if len(p[0]):
            held.append(np.stack([left[0], np.maximum.reduceat(left[1], np.cumsum(p[2]) - p[2])], 1))
    word, doc, own, gram = (np.concatenate([p[k] for p in parts]) for k in range(4))
    del parts
    x, (w, c, cuts) = m.inputs(word, own, gram)
    x[:, :2] = np.concatenate(held)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    at, size, owner = windows(count)
    at = at + first[owner]
    lexical = np.concatenate(([0], np.cumsum(np.maximum(x[:, 0], 0) + np.maximum(x[:, 1], 0))))
    value = lexical[at + size] - lexical[at]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.p.items()}
    tick = 0
    rounds = max(5, -(-updates // -(-2 * len(texts) // BATCH)))
    for turn in range(rounds):
        order = np.lexsort((value, owner))
        top = order[np.append(owner[order][1:] != owner[order][:-1], True)]  # the highest window of each text
        calm = np.flatnonzero(y[owner] == 0)
        calm = rng.choice(calm, min(len(calm), len(top)), replace=False)
        batch_of = rng.permutation(np.concatenate([top, calm]))
        for i in range(0, len(batch_of), BATCH):
            g = batch_of[i:i + BATCH]
            step = np.arange(int(size[g].max()))[:, None]
            on = (step < size[g][None, :]).astype(np.float32)
            idx = np.where(on > 0, at[g][None, :] + step, 0)
            wi = w[idx]
            xi = x[idx]
            xi[:, :, 2:2 + VEC] = m.p["word"][wi]
            grads, dx = gradients(m, xi * on[:, :, None], on, y[owner[g]])
            dx = dx * on[:, :, None]
            dw = np.zeros_like(m.p["word"])
            np.add.at(dw, wi.ravel(), dx[:, :, 2:2 + VEC].reshape(-1, VEC))
            used = np.flatnonzero(on.ravel())
            words_used, where = np.unique(idx.ravel()[used], return_inverse=True)
            dv = np.zeros((len(words_used), VEC), np.float32)
            np.add.at(dv, where, dx[:, :, 2 + VEC:].reshape(-1, VEC)[used])
            dv /= np.sqrt(own[words_used], dtype=np.float32)[:, None]
            n = own[words_used]
            spot = np.repeat(cuts[words_used], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            dc = np.stack([np.bincount(c[spot], np.repeat(dv[:, k], n), BUCKETS) for k in range(VEC)], 1).astype(np.float32)
            grads |= {"word": dw, "char": dc}
            tick += 1
            for k, gr in grads.items():
                m1, m2 = moment[k]
                m1 += 0.1 * (gr - m1)
                m2 += 0.01 * (gr * gr - m2)
                rate = 0.02 * (1 - turn / rounds) + 0.002
                if k in ("word", "char"):
                    m.p[k] *= 1 - rate * DECAY
                m.p[k] -= (rate * m1 / (1 - 0.9 ** tick) / (np.sqrt(m2 / (1 - 0.99 ** tick)) + 1e-6)).astype(np.float32)
        for a in range(0, len(words_of := np.arange(len(word))), 1 << 16):
            part = words_of[a:a + (1 << 16)]
            lo, hi = cuts[part[0]], cuts[part[-1] + 1] if part[-1] + 1 < len(cuts) else len(gram)
            for k in range(VEC):
                x[part, 2 + VEC + k] = np.add.reduceat(m.p["char"][:, k][c[lo:hi]], cuts[part] - lo) / np.sqrt(own[part])
            x[part, 2:2 + VEC] = m.p["word"][w[part]]
        for a in range(0, len(at), LANES):
            g = slice(a, a + LANES)
            step = np.arange(int(size[g].max()))[:, None]
            on = (step < size[g][None, :]).astype(np.float32)
            idx = np.where(on > 0, at[g][None, :] + step, 0)
            value[g] = forward(m, products(m, x[idx] * on[:, :, None]), on)
    return m


def held_out(id):
    """Documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where(~held_out(F.col("doc_id"))).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = None
    for c in (0, 1):
        one = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= LONGEST)
            .join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).collect())
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows])) if rows else None


def scores(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """The named columns of the documents with `score`."""
    settled(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    body = fresh(docs, "body_")
    base = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(body))
    kept = [f for f in base.schema if f.name != body]

    def run(batches):
        m = sent.value
        for part, _, _ in pieces(batches, body):
            texts = part.column(body).to_pylist()
            got = score(m, texts) if m is not None else np.zeros(len(texts), np.float32)
            rest = part.select([f.name for f in kept])
            yield pa.record_batch([*rest.columns, pa.array(got.astype(np.float64))], names=[*rest.schema.names, "score"])

    schema = base.select(*columns).schema.add("score", "double")
    return base.mapInArrow(run, schema)
