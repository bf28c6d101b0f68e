"""Detectors of every kind in the place of a lexicon."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.detectors import Called, Consensus, Scored, Table
from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import estimators as E
from ledgerloom.operators import pairs as D
from ledgerloom.operators import provenance as V
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import masks_named, query, rounded
from ledgerloom.plans.detection import STRICT, THRESHOLDS
from ledgerloom.plans.provenance import _v6

LEX = "prose"
PATTERNS = lexicon(LEX)
FAMS = list(PATTERNS)


def density(patterns):
    """Matches per character of a sentence."""
    def of(s):
        return sum((X.pattern_count(s, p) for p in patterns), F.lit(0)) / F.length(s)
    return of


SCORED = Scored({f: density(PATTERNS[f]) for f in THRESHOLDS}, THRESHOLDS)
AGREED = Consensus(["prose", "prose_loose", STRICT], 2)


def scored_table(t) -> Table:
    """The scores of all sentences as a table of detections, as a model's output would be."""
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), c.alias("text")) for p, c in (
        ("output", F.col("output")), ("upstream", V.join_upstream("upstream")))]))
    each = t.runs.select("run_id", parts.alias("e")).select("run_id", "e.*")
    found = F.explode(X.let(X.sentence_offsets("text"), lambda so: F.transform(so, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("s")))))
    sentences = each.select("run_id", "part", found.alias("e")).select("run_id", "part", "e.*")
    scores = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), density(PATTERNS[f])(F.col("s")).alias("score")) for f in THRESHOLDS]))
    return Table(sentences.select("run_id", "part", "start", "end", scores.alias("e")).select("run_id", "part", "start", "end", "e.*")
                 .where("score > 0"), list(THRESHOLDS), thresholds=THRESHOLDS)


def regular(texts):
    """A detector outside Spark's own expressions."""
    rules = [(f, re.compile(p, re.IGNORECASE | re.ASCII)) for f, ps in PATTERNS.items() for p in ps]
    return [[(m.start(), m.end(), f) for f, r in rules for m in r.finditer(re.sub("[^\\x00-\\x7f]", "z", t))] for t in texts]


# oracles

def votes_mask(t: str, _lex=None) -> str:
    def one(i, f):
        n = " + ".join(f"(({K.mask(t, lex)} & {1 << i}) <> 0)::INT" for lex in ("prose", "prose_loose", STRICT))
        return f"(CASE WHEN {n} >= 2 THEN {1 << i} ELSE 0 END)"
    return "(" + " + ".join(one(i, f) for i, f in enumerate(FAMS)) + ")"


def reached(s: str, f: str) -> str:
    return f"{K.count(s, PATTERNS[f])} / length({s})::DOUBLE >= {THRESHOLDS[f]}"


def scored_mask(t: str, _lex=None) -> str:
    return "(" + " + ".join(f"(CASE WHEN len(list_filter({K.sents(t)}, lambda x: {reached('x', f)})) > 0 THEN {1 << i} ELSE 0 END)"
                            for i, f in enumerate(THRESHOLDS)) + ")"


def audit_sql(mask, names) -> str:
    lex = {f: [] for f in names}
    return f"""WITH {K.DEALT}, {K.audited(lex, mask=mask)} SELECT run_id, chars::BIGINT AS chars, {K.names('raised', lex)} AS raised,
  {K.names('kept', lex)} AS kept, {K.names('invented', lex)} AS invented, supply::INT AS supply, round(traceability, 6) AS traceability FROM aud"""


def audited(t, det):
    a = masks_named(V.audit(t.runs, det), det, raised="raised_mask", kept="kept_mask", invented="invented_mask")
    return rounded(a.select("run_id", F.col("chars").cast("bigint").alias("chars"), "raised", "kept", "invented", "supply", "traceability"))


@query("u1_audit_scored", audit_sql(scored_mask, THRESHOLDS))
def u1_audit_scored(t):
    """Audit by sentence scores against thresholds, in the row."""
    return audited(t, SCORED)


@query("u1_audit_table", audit_sql(scored_mask, THRESHOLDS))
def u1_audit_table(t):
    """The same scores from a table of detections, joined by run."""
    return audited(t, scored_table(t))


@query("u1_audit_consensus", audit_sql(votes_mask, FAMS))
def u1_audit_consensus(t):
    """Audit by two of three instruments."""
    return audited(t, AGREED)


@query("u2_audit_called", audit_sql(lambda text, _lex: K.mask(text, LEX), FAMS))
def u2_audit_called(t):
    """Audit by a Python function over batches of texts."""
    return audited(t, Called(regular, FAMS))


@query("u1_transmission_consensus", _v6().replace(K.audited(LEX), K.audited(LEX, mask=votes_mask)))
def u1_transmission_consensus(t):
    return rounded(V.transmission(V.audit(t.runs, AGREED), AGREED))


TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def ablate_sql(text: str, gone: str, any_: str) -> str:
    ss = K.sents(text)
    kept = TRIM.format("array_to_string(list_transform(list_filter(%s, lambda x: NOT (%s)), lambda x: %s), ' ')" % (ss, gone, TRIM.format("x")))
    return f"CASE WHEN NOT ({any_}) THEN {text} ELSE {kept} END"


_ax = K.ascii_text("x")
_scored_gone = " OR ".join(f"{reached(_ax, f)}" for f in THRESHOLDS)
_both = " | ".join(K.mask(_ax, lex) for lex in ("prose", "prose_loose", STRICT))


@query("u1_ablate_scored", f"""WITH d AS MATERIALIZED (SELECT doc_id, text, {scored_mask(K.ascii_text('text'))} AS m FROM documents)
  SELECT doc_id, md5({ablate_sql('text', _scored_gone, 'm <> 0')}) AS kept FROM d""")
def u1_ablate_scored(t):
    """Texts without the sentences whose score reaches a threshold."""
    return D.ablate(t.documents, "text", SCORED).select("doc_id", F.md5("ablated").alias("kept"))


@query("u1_ablate_consensus", f"""WITH d AS MATERIALIZED (SELECT doc_id, text, {votes_mask(K.ascii_text('text'))} AS m FROM documents)
  SELECT doc_id, md5({ablate_sql('text', f'(({_both}) & m) <> 0', 'm <> 0')}) AS kept FROM d""")
def u1_ablate_consensus(t):
    """Texts without the sentences in which a family starts that two of three instruments see."""
    return D.ablate(t.documents, "text", AGREED).select("doc_id", F.md5("ablated").alias("kept"))


_fm = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS family, list_filter(ss, lambda x: {reached(_ax, f)}) AS hit FROM s" for f in THRESHOLDS)


@query("u1_feature_mask_scored", f"""WITH s AS (SELECT doc_id, {K.sents('text')} AS ss FROM documents)
  SELECT doc_id, len(h)::INT AS spans, list_aggregate(list_transform(h, lambda x: length(x)), 'sum')::BIGINT AS chars
  FROM (SELECT doc_id, list_filter(ss, lambda x: {_scored_gone}) AS h FROM s) WHERE len(h) > 0""")
def u1_feature_mask_scored(t):
    m = D.feature_mask(t.documents, "text", SCORED).where(F.size("mask") > 0)
    return m.select("doc_id", F.size("mask").alias("spans"),
                    F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("chars"))


@query("u1_span_fraction_consensus", f"""WITH {K.DEALT}, r AS MATERIALIZED (SELECT condition, output, {votes_mask(K.ascii_text('output'))} AS m FROM runs WHERE length(output) >= 200),
  f AS (SELECT condition, coalesce(list_aggregate(list_transform(list_filter({K.sents('output')}, lambda x: (({_both}) & m) <> 0), lambda x: length(x)), 'sum'), 0) / length(output)::DOUBLE AS f FROM r)
  SELECT condition, count(*) AS n_runs, round(median(f), 6) AS f_median FROM f GROUP BY 1""")
def u1_span_fraction_consensus(t):
    return rounded(E.span_fraction(t.runs, AGREED).select("condition", "n_runs", "f_median"))


_first = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS family, list_filter({K.sents('text')}, lambda x: {reached(_ax, f)})[1] AS s, text FROM documents" for f in THRESHOLDS)


@query("u1_drop_pairs_scored", f"""WITH p AS (SELECT doc_id, family, length(text) - length(s) AS n FROM ({_first}) WHERE s IS NOT NULL)
  SELECT doc_id, family FROM p WHERE n >= 400""")
def u1_drop_pairs_scored(t):
    """A pair for each family whose score reaches its threshold, where much text is left."""
    refs = t.documents.withColumn("targets", F.array(*[F.lit(f) for f in THRESHOLDS]))
    p = D.drop_pairs(refs, "text", "targets", SCORED, ["doc_id"], min_chars=1)
    return p.where(F.length("chosen") - F.expr("chosen_spans[0].end - chosen_spans[0].start") >= 400).select("doc_id", "family")
