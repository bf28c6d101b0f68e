"""Detectors: whatever tells which families a text shows, behind one protocol.

Every operator that takes a lexicon for `lex` takes a detector too:

Lexical    patterns (what a lexicon means everywhere)
Scored     a score per sentence and family, as column expressions, against thresholds
Called     a Python function over batches of texts (a classifier, a rule of your own)
Table      detections made elsewhere: (key, part, family, start, end, score), joined by key
Consensus  families that at least k of several detectors agree on

A detector has `names`, its families in the order of the mask bits. `prepared` adds to a table what the detector needs for the
named parts (nothing, but for a join); `mask` and `spans` are then column expressions over a part's text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon

SPAN = "struct<start:int,end:int,family:string>"
#: Columns that `prepared` adds begin with this.
MARK = "_det_"


class Detector:
    """One instrument. `reads_text` is false where the texts themselves aren't needed."""

    names: list[str]
    reads_text = True

    def prepared(self, df: DataFrame, parts: Sequence[str]) -> DataFrame:
        return df

    def mask(self, part: str, text) -> Column:
        """Bigint with bit i set where family i is there; null text gives 0."""
        found = self.spans(part, text)

        def has(name):
            return lambda p: p["family"] == name
        return X.let(found, lambda spans: _bits([F.exists(spans, has(n)) for n in self.names]))

    def spans(self, part: str, text) -> Column:
        """Sorted array of (start, end, family); empty for a null text."""
        raise NotImplementedError(f"{type(self).__name__} has no offsets")


def _bits(flags: Sequence[Column]) -> Column:
    zero = F.lit(0).cast("bigint")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << i).cast("bigint")).otherwise(zero) for i, f in enumerate(flags)], zero)


def _held(names: Sequence[str]) -> list[str]:
    if len(set(names)) != len(names) or not 0 < len(names) <= 62:
        raise ValueError("a detector has 1 to 62 different families (one bit each in a bigint)")
    return list(names)


class Lexical(Detector):
    def __init__(self, lex):
        self.lex = lexicon(lex)
        self.names = list(self.lex)

    def mask(self, part, text):
        return X.families_mask(text, self.lex)

    def spans(self, part, text):
        return X.spans(text, self.lex)


class Scored(Detector):
    """A family is there when some sentence's score reaches its threshold; such sentences are its spans.

    scores  family -> function of a sentence column, giving a number (null: no score)
    """

    def __init__(self, scores: Mapping[str, Callable[[Column], Column]], thresholds: Mapping[str, float]):
        self.names = _held([f for f in scores if f in thresholds])

        def reached(f):
            return lambda s: F.coalesce(scores[f](s) >= F.lit(thresholds[f]), F.lit(False))
        self.reached = {f: reached(f) for f in self.names}

    def mask(self, part, text):
        sentences = X.sentences(F.coalesce(X.as_col(text), F.lit("")))
        return X.let(sentences, lambda ss: _bits([F.exists(ss, self.reached[f]) for f in self.names]))

    def spans(self, part, text):
        t = F.coalesce(X.as_col(text), F.lit(""))

        def located(sentences):
            def of(f):
                hit = F.filter(sentences, lambda s: self.reached[f](s["s"]))
                return F.transform(hit, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f).alias("family")))
            return F.sort_array(F.flatten(F.array(*[of(f) for f in self.names])))
        # the sentences themselves, since a place in a string is found by walking there from its start
        return X.let(F.zip_with(X.sentence_offsets(t), X.sentences(t), lambda o, s: F.struct(
            o["start"].alias("start"), o["end"].alias("end"), s.alias("s"))), located)


class Called(Detector):
    """A function over a batch of texts (a pandas series without nulls): per text the spans (start, end, family) it finds.

    Families outside `names` are left out. A function that only knows families returns them as (0, 0, family). Runs in
    Arrow batches; it must give equal results for equal texts.
    """

    def __init__(self, fn: Callable[[pd.Series], Sequence], names: Sequence[str]):
        self.names = _held(names)
        known = set(names)

        def found(texts: pd.Series) -> pd.Series:
            there = texts.notna()
            out = pd.Series([[] for _ in range(len(texts))], index=texts.index, dtype=object)
            for at, spans in zip(texts.index[there], fn(texts[there])):
                out[at] = sorted((int(a), int(b), f) for a, b, f in spans if f in known)
            return out.map(lambda spans: [{"start": a, "end": b, "family": f} for a, b, f in spans])
        self.udf = F.pandas_udf(found, f"array<{SPAN}>")

    def spans(self, part, text):
        return self.udf(X.as_col(text))


class Table(Detector):
    """Detections of any origin: columns `key`, part, family, and start, end, score where there are any.

    thresholds  family -> least score (families without one are ignored); without it every row counts. Rows fold to one mask
                and one array of spans per text before they meet the texts, so the join is one to one on the key. Rows
                without offsets count for the mask only.
    """

    reads_text = False

    def __init__(self, detections: DataFrame, names: Sequence[str], key: str = "run_id", thresholds: Mapping[str, float] | None = None,
                 tag: str = "t"):
        self.names, self.key, self.tag = _held(names), key, tag
        found = detections.select(key, "part", "family", *[
            (F.col(c) if c in detections.columns else F.lit(None)).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("score", "double"))])
        if thresholds is not None:
            cut = F.create_map(*[F.lit(x) for f, v in thresholds.items() for x in (f, float(v))])
            found = found.where(F.col("score") >= F.try_element_at(cut, F.col("family")))
        self.found = found.where(F.col("family").isin(self.names))

    def column(self, part: str, what: str) -> str:
        return f"{MARK}{self.tag}_{part}_{what}"

    def prepared(self, df, parts):
        order = F.create_map(*[F.lit(x) for i, f in enumerate(self.names) for x in (f, 1 << i)])
        bit = F.try_element_at(order, F.col("family")).cast("bigint")
        span = F.when(F.col("start").isNotNull(), F.struct("start", "end", "family"))
        out = []
        for part in parts:
            on = F.col("part") == part
            out += [F.bit_or(F.when(on, bit)).alias(self.column(part, "mask")),
                    F.sort_array(F.collect_set(F.when(on, span))).alias(self.column(part, "spans"))]
        folded = self.found.where(F.col("part").isin(list(parts))).groupBy(self.key).agg(*out)
        return df.join(folded, self.key, "left")

    def mask(self, part, text):
        return F.coalesce(F.col(self.column(part, "mask")), F.lit(0).cast("bigint"))

    def spans(self, part, text):
        return F.coalesce(F.col(self.column(part, "spans")), F.array().cast(f"array<{SPAN}>"))


class Consensus(Detector):
    """Families that at least k detectors agree on; spans are all members' spans of those families."""

    def __init__(self, members: Sequence, k: int = 2):
        self.members = [detector(m) for m in members]
        if len(self.members) < 2 or not 1 <= k <= len(self.members):
            raise ValueError("consensus needs at least two instruments and 1 <= k <= n")
        self.k = k
        self.names = _held(list(dict.fromkeys(n for m in self.members for n in m.names)))
        self.reads_text = any(m.reads_text for m in self.members)
        tables = [m for m in self.members if isinstance(m, Table)]
        if len({m.tag for m in tables}) < len(tables):
            raise ValueError("tables of one consensus need different tags")

    def prepared(self, df, parts):
        return reduce(lambda d, m: m.prepared(d, parts), self.members, df)

    def _agreed(self, masks: Sequence[Column]) -> list[Column]:
        def votes(name):
            return reduce(lambda a, b: a + b, [X.mask_has(v, m.names.index(name)).cast("int") for m, v in zip(self.members, masks) if name in m.names])
        return [votes(n) >= self.k for n in self.names]

    def mask(self, part, text):
        masks = F.array(*[m.mask(part, text) for m in self.members])
        return X.let(masks, lambda a: _bits(self._agreed([F.get(a, F.lit(i)) for i in range(len(self.members))])))

    def spans(self, part, text):
        found = F.array_distinct(F.flatten(F.array(*[m.spans(part, text) for m in self.members])))
        both = F.struct(found.alias("s"), self.mask(part, text).alias("m"))
        bit = F.create_map(*[F.lit(x) for i, n in enumerate(self.names) for x in (n, 1 << i)])
        return X.let(both, lambda e: F.sort_array(F.filter(
            e["s"], lambda p: e["m"].bitwiseAND(F.element_at(bit, p["family"]).cast("bigint")) != 0)))


def detector(spec) -> Detector:
    """A detector as it is, and anything that names a lexicon as its lexical detector."""
    return spec if isinstance(spec, Detector) else Lexical(spec)


def plain(df: DataFrame) -> DataFrame:
    """Without what `prepared` has added."""
    return df.drop(*[c for c in df.columns if c.startswith(MARK)])
