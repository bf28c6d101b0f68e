"""Text detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.lexicons import NAMED, lexicon
from ledgerloom.operators import detection as D
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded

LEX = "prose"
FAMS = list(lexicon(LEX))
DOC = f"WITH d AS MATERIALIZED (SELECT *, {K.ascii_text('text')} AS t FROM documents)"


@query("t1_families", f"{DOC}, m AS (SELECT doc_id, {K.mask('t', LEX)} AS m FROM d) SELECT doc_id, {K.names('m', LEX)} AS families FROM m")
def t1_families(t):
    return t.documents.select("doc_id", F.array_join(X.families("text", LEX), ",").alias("families"))


@query("t2_counts", f"{DOC} SELECT doc_id, " + ", ".join(
    f"{K.count('t', ps)}::INT AS n_{f}" for f, ps in lexicon(LEX).items()) + " FROM d")
def t2_counts(t):
    return t.documents.select("doc_id", *[c.cast("int").alias(f"n_{f}") for f, c in X.family_counts("text", LEX).items()])


@query("t3_matches", f"{DOC} " + " UNION ALL ".join(
    "SELECT doc_id, '" + f + "' AS family, array_to_string((" + " || ".join(f"regexp_extract_all(t, {K.q(p)}, 0, 'i')" for p in ps)
    + ")[1:5], '|') AS matches FROM d WHERE " + K.count("t", ps) + " > 0" for f, ps in lexicon(LEX).items()))
def t3_matches(t):
    m = t.documents.select("doc_id", F.explode_outer(X.family_matches("text", LEX)).alias("family", "m")).where("family is not null")
    return m.select("doc_id", "family", F.regexp_replace(F.array_join("m", "|"), r"[^\x00-\x7F]", "z").alias("matches"))


_firsts = ", ".join(
    f"CASE WHEN regexp_matches(t, {K.q(p)}, 'i') THEN length(regexp_extract(t, {K.q('(?s)^(.*?)(?:' + p + ')')}, 1, 'i')) END"
    for ps in lexicon(LEX).values() for p in ps)
_covered = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(t, {K.q(p)}, 0, 'i'), lambda x: length(x))), 0)"
                      for ps in lexicon(LEX).values() for p in ps)


@query("t4_spans", f"{DOC} SELECT doc_id, {K.total('t', LEX)}::INT AS n_spans, ({_covered})::BIGINT AS covered, least({_firsts})::INT AS first_start FROM d")
def t4_spans(t):
    """Exact character spans of every match, summarised per document."""
    s = X.held(t.documents.select("doc_id", "text"), "sp", X.spans("text", LEX))
    return s.select("doc_id", F.size("sp").alias("n_spans"),
                    F.aggregate("sp", F.lit(0).cast("bigint"), lambda a, e: a + e["end"] - e["start"]).alias("covered"),
                    F.get("sp", F.lit(0))["start"].alias("first_start"))


def _t5_rows(fmt):
    return [fmt(name, f, ps) for name in ("prose", "prose_loose", "attribution", "epistemic", "disposition", "pair_gate")
            for f, ps in NAMED[name].items()]


def _hit(ps):
    return " OR ".join(f"regexp_matches(t, {K.q(p)}, 'i')" for p in ps)


@query("t5_property_classes", f"{DOC} " + " UNION ALL ".join(_t5_rows(
    lambda n, f, ps: f"SELECT '{n}' AS property_class, '{f}' AS family, {len(ps)} AS patterns, count(*) FILTER ({_hit(ps)}) AS docs FROM d")))
def t5_property_classes(t):
    """Every shipped property class over all documents, in one pass."""
    rows = [(n, f, ps) for n in ("prose", "prose_loose", "attribution", "epistemic", "disposition", "pair_gate")
            for f, ps in NAMED[n].items()]
    every = X.held(t.documents.select("text"), "m", X.families_mask("text", {f"{n} {f}": ps for n, f, ps in rows}))
    one = every.agg(*[F.count_if(X.mask_has("m", i)).alias(f"c{i}") for i in range(len(rows))])
    each = F.explode(F.array(*[
        F.struct(F.lit(n).alias("property_class"), F.lit(f).alias("family"), F.lit(len(ps)).alias("patterns"),
                 F.col(f"c{i}").alias("docs")) for i, (n, f, ps) in enumerate(rows)]))
    return one.select(each.alias("e")).select("e.*")


STRICT = {f: ps[:1] for f, ps in lexicon(LEX).items()}


@query("t6_consensus", f"""{DOC}, m AS (SELECT doc_id, {K.mask('t', 'prose')} AS a, {K.mask('t', 'prose_loose')} AS b, {K.mask('t', STRICT)} AS c FROM d),
  v AS ({' UNION ALL '.join(f"SELECT doc_id, '{f}' AS family, ((a & {1 << i}) <> 0)::INT + ((b & {1 << i}) <> 0)::INT + ((c & {1 << i}) <> 0)::INT AS votes FROM m" for i, f in enumerate(FAMS))})
  SELECT family, count(*) FILTER (votes >= 2) AS two_of_three, count(*) FILTER (votes >= 3) AS all_three FROM v GROUP BY 1""")
def t6_consensus(t):
    """k-of-n agreement of three detectors, decided inside the row."""
    m = t.documents.select(X.families_mask("text", "prose").alias("a"), X.families_mask("text", "prose_loose").alias("b"),
                           X.families_mask("text", STRICT).alias("c"))
    c = m.select(D.consensus_mask(["a", "b", "c"], LEX, 2).alias("k2"), D.consensus_mask(["a", "b", "c"], LEX, 3).alias("k3"))
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), X.mask_has("k2", i).alias("h2"), X.mask_has("k3", i).alias("h3")) for i, f in enumerate(FAMS)]))
    g = c.groupBy("k2", "k3").agg(F.count("*").alias("n")).select(each.alias("e"), "n")
    return g.groupBy("e.family").agg(F.sum(F.when(F.col("e.h2"), F.col("n")).otherwise(0)).alias("two_of_three"),
                                     F.sum(F.when(F.col("e.h3"), F.col("n")).otherwise(0)).alias("all_three"))


@query("t7_any_detector", f"""{DOC}, det AS ({' UNION ALL '.join(f"SELECT doc_id, '{n}' AS ins, '{f}' AS family FROM d WHERE {_hit(lexicon(l)[f])}" for n, l in (('one', 'prose'), ('two', 'prose_loose')) for f in FAMS)}
    UNION ALL SELECT doc_id, 'three', 'figure' FROM d WHERE regexp_matches(t, '[0-9]{{3}}'))
  SELECT doc_id AS text_id, family, count(DISTINCT ins) AS votes FROM det GROUP BY 1, 2 HAVING count(DISTINCT ins) >= 2""")
def t7_any_detector(t):
    """Consensus over a detections table, which is how any outside detector takes part."""
    both = t.documents.select("doc_id", F.array(
        F.struct(F.lit("one").alias("ins"), X.families("text", "prose").alias("fs")),
        F.struct(F.lit("two").alias("ins"), X.families("text", "prose_loose").alias("fs")),
        F.struct(F.lit("three").alias("ins"), F.when(F.col("text").rlike("[0-9]{3}"), F.array(F.lit("figure")))
                 .otherwise(F.array().cast("array<string>")).alias("fs"))).alias("d"))
    det = both.select("doc_id", F.explode_outer("d").alias("d")).select("doc_id", "d.ins", F.explode_outer("d.fs").alias("family"))
    det = det.where("family is not null").select(F.col("doc_id").alias("text_id"), F.col("ins").alias("instrument"), "family")
    return D.consensus(det, 2)


THRESHOLDS = {"agent": 0.02, "figure": 0.01, "linking": 0.02, "nominal": 0.01, "stative": 0.02}
_score = {f: f"round({K.count('s', lexicon(LEX)[f])} / length(s)::DOUBLE, 6)" for f in THRESHOLDS}


@query("t8_threshold_detect", f"""{DOC}, se AS (SELECT doc_id, unnest({K.sents('t')}) AS s FROM d),
  sc AS ({' UNION ALL '.join(f"SELECT doc_id, '{f}' AS family, {e} AS score, {THRESHOLDS[f]} AS th FROM se" for f, e in _score.items())})
  SELECT doc_id AS text_id, family, round(max(score), 6) AS max_score, count(*) FILTER (score >= th) AS hits, count(*) AS sentences,
   max(score) >= max(th) AS present, round(count(*) FILTER (score >= th) * 10 / count(*)::DOUBLE, 6) AS density FROM sc GROUP BY 1, 2""")
def t8_threshold_detect(t):
    """Sentence scores (match density) against frozen thresholds."""
    counts = X.family_counts("s", LEX)
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), F.round(counts[f] / F.length("s"), 6).alias("score")) for f in THRESHOLDS]))
    scores = t.sentences.select(F.col("doc_id").alias("text_id"), each.alias("e")).select("text_id", "e.*")
    return rounded(D.threshold_detect(scores, THRESHOLDS))


_dens = f"CASE WHEN length(t) > 0 THEN {K.total('t', LEX)} / length(t)::DOUBLE * 1000 ELSE 0 END"


@query("t9_disposition", f"""{DOC}, x AS (SELECT doc_id, {_dens} AS density, bit_count({K.mask('t', LEX)})::INT AS k FROM d)
  SELECT doc_id, round(density, 6) AS density, round(k / 6::DOUBLE, 6) AS breadth, round(density * sqrt(k / 6::DOUBLE), 6) AS composite FROM x""")
def t9_disposition(t):
    return rounded(D.disposition(t.documents, "text", LEX, ["doc_id"]))


def _dn(c):
    a = K.ascii_text(c)
    return f"CASE WHEN length({c}) > 0 THEN {K.total(a, LEX)} / length({c})::DOUBLE * 1000 ELSE 0 END"


@query("t10_lift_ratio", f"""WITH {K.DEALT}, g AS (SELECT prompt_id, avg({_dn('output')}) AS a, avg({_dn('alpha')}) AS b FROM runs GROUP BY 1)
  SELECT prompt_id, round(a, 6) AS a, round(b, 6) AS b, round(CASE WHEN a > 0 AND b > 0 THEN a / b END, 6) AS lift FROM g""")
def t10_lift_ratio(t):
    modes = t.dealt.select("prompt_id", F.explode(F.array(
        F.struct(F.lit("panel").alias("mode"), F.col("output").alias("text")),
        F.struct(F.lit("single").alias("mode"), F.col("alpha").alias("text")))).alias("e")).select("prompt_id", "e.*")
    scored = modes.select("prompt_id", "mode", D.density("text", LEX).alias("d"))
    return rounded(D.lift_ratio(scored, "prompt_id", "mode", "d", "panel", "single"))


_fd = " UNION ALL ".join(
    f"SELECT seat, '{f}' AS family, {K.count(K.ascii_text('text'), ps)} / length(text)::DOUBLE * 1000 AS d FROM st" for f, ps in lexicon(LEX).items())
SEATS = f"st AS MATERIALIZED ({' UNION ALL '.join(f'''SELECT run_id, condition, prompt_id, '{s}' AS seat, {s} AS text FROM runs WHERE {s} <> '' ''' for s in ('alpha', 'beta', 'gamma'))})"


@query("t11_family_density", f"WITH {K.DEALT}, {SEATS}, fd AS ({_fd}) SELECT seat, family, count(*) AS n, round(avg(d), 6) AS density FROM fd GROUP BY 1, 2")
def t11_family_density(t):
    return rounded(D.family_density(t.seats, LEX))


@query("t11_family_owner", f"""WITH {K.DEALT}, {SEATS}, fd AS ({_fd}), g AS (SELECT seat, family, round(avg(d), 9) AS d FROM fd GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY d DESC, seat) AS rn FROM g)
  SELECT family, CASE WHEN d > 0.3 THEN seat ELSE 'below detection' END AS owner, round(d, 6) AS density FROM r WHERE rn = 1""")
def t11_family_owner(t):
    return rounded(D.family_owner(D.family_density(t.seats, LEX)))


_rules = {"boundary": K.sents("text"), "judged": K.sents_len("text", 40, 400), "labelled": K.sents_len("text", 25, 400),
          "quoted": K.sents_len("text", 31, None)}
# a capital or digit must follow: mark every break, then only keep marks before A-Z0-9
_cap = ("list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), chr(30)),"
        " lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 20 AND length(x) <= 600)")


@query("t12_sentences", "SELECT doc_id, " + ", ".join(
    f"len({e})::INT AS n_{r}, coalesce(list_sum(list_transform({e}, lambda x: length(x))), 0)::BIGINT AS c_{r}"
    for r, e in {**_rules, "capital": _cap}.items()) + " FROM documents")
def t12_sentences(t):
    """Every sentence rule: how many and how many characters."""
    rules = ["boundary", "judged", "labelled", "quoted", "capital"]
    s = t.documents.select("doc_id", *[X.sentences("text", r).alias(r) for r in rules])
    return s.select("doc_id", *[x for r in rules for x in (
        F.size(r).alias(f"n_{r}"), F.aggregate(r, F.lit(0).cast("bigint"), lambda a, e: a + F.length(e)).alias(f"c_{r}"))])


TERMS = {"north": ["tion", "the ", "erst"], "south": ["eau", "elle", "que "], "east": ["heit", "ung ", "sch"]}


def _profile_sql() -> str:
    rates = ", ".join(
        "(" + " + ".join(f"contains(lower(text), {K.q(k)})::INT" for k in ks) + f") / greatest(length(text) / 1000.0, 1e-9) AS rate_{d}"
        for d, ks in TERMS.items())
    lines = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
    toks = ("list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), "
            "lambda w: regexp_replace(w, '^[.,;:()\\[\\]\"''*#]+|[.,;:()\\[\\]\"''*#]+$', '', 'g')), lambda w: w <> '')")
    sents = "list_filter(string_split(translate(text, '!?', '..'), '.'), lambda s: length(s) > 15 AND length(s) < 600)"
    return f"""WITH p AS MATERIALIZED (SELECT doc_id, {rates}, length(text) AS chars, {lines} AS l, {toks} AS tk, {sents} AS s FROM documents)
  SELECT doc_id, {', '.join(f'round(rate_{d}, 6) AS rate_{d}' for d in TERMS)}, chars::INT AS chars,
   round(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) / greatest(len(s), 1)::DOUBLE, 6) AS mean_sentence,
   round(len(list_filter(l, lambda x: substr(ltrim(x), 1, 2) IN ('- ', '* '))) / greatest(len(l), 1)::DOUBLE, 6) AS list_share,
   round(len(list_distinct(tk)) / greatest(len(tk), 1)::DOUBLE, 6) AS ttr FROM p"""


@query("t13_profile", _profile_sql())
def t13_profile(t):
    return rounded(D.profile(t.documents, "text", TERMS, ["doc_id"]))


_ws = lambda e: f"regexp_replace(regexp_replace({e}, '\\s+', ' ', 'g'), '^ +| +$', '', 'g')"


@query("t14_normalise", f"""SELECT doc_id, md5({_ws('text')}) AS h_space,
  md5({_ws("lower(regexp_replace(text, '[*_`#>]|<br\\s*/?>', '', 'g'))")}) AS h_markup,
  md5({_ws("lower(replace(replace(text, ',', ''), '$', ''))")}) AS h_amount,
  md5({_ws("lower(replace(replace(text, '*', ''), '$', ''))")}) AS h_money,
  md5(regexp_replace(replace(lower(replace(replace(replace(text, '*', ''), '$', ''), ',', '')), '-', ' '), '\\s+', ' ', 'g')) AS h_digits,
  md5(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))) AS h_word FROM documents""")
def t14_normalise(t):
    return t.documents.select("doc_id", *[F.md5(X.norm("text", r)).alias(f"h_{r}")
                                          for r in ("space", "markup", "amount", "money", "digits", "word")])


_words = lambda e: f"regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]+')"


def _grams(w: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"


@query("t15_ngram_overlap", f"""WITH {K.DEALT}, w AS MATERIALIZED (SELECT run_id, {_words('output')} AS a,
     {_words("concat_ws(' ', alpha, beta, gamma)")} AS b FROM runs),
  g AS MATERIALIZED (SELECT run_id, len(a) AS n, {_grams('a', 8)} AS g8, {_grams('b', 8)} AS s8, {_grams('a', 5)} AS g5 FROM w)
  SELECT run_id, round(len(list_intersect(g8, s8)) / greatest(len(g8), 1)::DOUBLE, 6) AS overlap,
   round(len(g5) / greatest(n - 4, 1)::DOUBLE, 6) AS distinct_ratio FROM g""")
def t15_ngram_overlap(t):
    """Copying from the sources (8-grams) and self-repetition (5-grams), inside the row."""
    w = t.dealt.select("run_id", X.words("output").alias("a"), X.words(F.concat_ws(" ", "alpha", "beta", "gamma")).alias("b"))
    g = w.select("run_id", F.size("a").alias("n"), X.ngrams(F.col("a"), 8).alias("g8"), X.ngrams(F.col("b"), 8).alias("s8"),
                 X.ngrams(F.col("a"), 5).alias("g5"))
    return rounded(g.select(
        "run_id", (F.size(F.array_intersect("g8", "s8")) / F.greatest(F.size("g8"), F.lit(1))).alias("overlap"),
        (F.size("g5") / F.greatest(F.col("n") - 4, F.lit(1))).alias("distinct_ratio")))


_caps = lambda e: f"list_distinct(regexp_extract_all(regexp_replace({e}, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][A-Za-z]{{2,}}\\b'))"


@query("t16_content_overlap", f"""WITH {K.DEALT}, c AS MATERIALIZED (SELECT run_id, {_caps('output')} AS a, {_caps('alpha')} AS b FROM runs)
  SELECT run_id, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE ELSE 1 END, 6) AS overlap FROM c""")
def t16_content_overlap(t):
    return rounded(t.dealt.select("run_id", X.content_overlap("output", "alpha").alias("overlap")))


@query("t17_answer_figures", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'size ' || n_chars || ' of ' || source END AS answer,
  len(regexp_extract_all(text, '\\$?\\d[\\d,\\.]+\\s?(?:k|K|%|m|M|bn|million|billion)?'))::INT AS n_figures,
  coalesce(list_sort(regexp_extract_all(text, '\\$?\\d[\\d,\\.]+\\s?(?:k|K|%|m|M|bn|million|billion)?'))[1], '') AS first_figure
  FROM documents""")
def t17_answer_figures(t):
    """Last ANSWER line (appended to a third of the documents) and figures of the text."""
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(
        "text", F.lit("\nanswer: ignored\nANSWER:  size "), F.col("n_chars").cast("string"), F.lit(" of "), "source", F.lit("  \nend")
    )).otherwise(F.col("text"))
    f = X.figures("text")
    return t.documents.select("doc_id", X.answer_line(body).alias("answer"), F.size(f).alias("n_figures"),
                              F.coalesce(F.array_min(f), F.lit("")).alias("first_figure"))


_T18 = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  e AS (SELECT doc_id, unnest(list_transform(ls, lambda x: length(x))) AS n, generate_subscripts(ls, 1) AS i FROM l),
  s AS (SELECT doc_id, i, n, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM e),
  r AS (SELECT doc_id, st AS "start", st + n * (CASE WHEN i % 3 = 0 THEN 3 ELSE 1 END) AS "end", 'k' || (i % 4) AS label FROM s WHERE n > 0),
  m AS (SELECT *, max("end") OVER w AS pv FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  g AS (SELECT *, sum((pv IS NULL OR "start" >= pv)::INT) OVER (PARTITION BY doc_id ORDER BY "start", "end", label) AS isl FROM m)
  SELECT doc_id, min("start")::BIGINT AS "start", max("end")::BIGINT AS "end", arg_min(label, "start") AS label FROM g GROUP BY doc_id, isl"""


@query("t18_merge_ranges", _T18)
def t18_merge_ranges(t):
    """Overlapping ranges laid over the lines of each document, merged."""
    lens = F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("bigint"))
    acc = F.aggregate(
        lens, F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("i"),
                       F.array().cast("array<struct<start:bigint,n:bigint,i:int>>").alias("o")),
        lambda a, n: F.struct((a["pos"] + n + 1).alias("pos"), (a["i"] + 1).alias("i"), F.concat(a["o"], F.array(F.struct(
            a["pos"].alias("start"), n.alias("n"), (a["i"] + 1).alias("i")))).alias("o")))["o"]
    r = X.explode_rows(t.documents, ["doc_id"], acc, "pos", "e").where("e.n > 0").select(
        "doc_id", "e.start", (F.col("e.start") + F.col("e.n") * F.when(F.col("e.i") % 3 == 0, 3).otherwise(1)).alias("end"),
        F.concat(F.lit("k"), (F.col("e.i") % 4).cast("string")).alias("label"))
    return D.merge_ranges(r, "doc_id")


MARKS = ("lang=", "</p>")


@query("t19_extract_phrases", """WITH s AS (SELECT page_id, html FROM pages),
  qu AS (SELECT page_id, 'quoted' AS kind, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT page_id, list_transform(regexp_extract_all(html, '"[^"]*"'), lambda x: x[2:-2]) AS l FROM s)),
  ex AS (""" + " UNION ALL ".join(
    f"SELECT page_id, {1000000 * (n + 1)} AS base, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT page_id, list_transform(range(2, (len(c) + 1)::BIGINT), "
    f"lambda k: array_to_string(c[k:], {K.q(m)})) AS l FROM (SELECT page_id, string_split(html, {K.q(m)}) AS c FROM s))" for n, m in enumerate(MARKS)) + """),
  ec AS (SELECT page_id, 'example' AS kind, CASE WHEN contains(p, chr(10) || chr(10)) THEN string_split(p, chr(10) || chr(10))[1] ELSE substr(p, 1, 320) END AS p, base + i AS i FROM ex),
  es AS (SELECT page_id, kind, regexp_replace(regexp_replace(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), '^-+|-+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS p, i FROM ec),
  a AS (SELECT page_id, kind, regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS phrase, i FROM (SELECT * FROM qu UNION ALL SELECT * FROM es)),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(phrase) ORDER BY i) AS rn FROM a WHERE length(phrase) BETWEEN 3 AND 400)
  SELECT page_id, kind, count(*) AS phrases, sum(length(phrase))::BIGINT AS chars FROM r WHERE rn = 1 GROUP BY 1, 2""")
def t19_extract_phrases(t):
    """Quoted strings and marked segments of raw pages, distinct per page (markers bound to the pages)."""
    p = D.extract_phrases(t.spread("pages", "page_id"), "page_id", "html", MARKS)
    return p.groupBy("page_id", "kind").agg(F.count("*").alias("phrases"), F.sum(F.length("phrase")).cast("bigint").alias("chars"))


_dig = "sha256(to_json([doc_id::VARCHAR, source, lang])::VARCHAR)"


@query("t20_registry_digest", f"""WITH a AS (SELECT doc_id // 1024 AS g, sha256(string_agg({_dig}, '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1),
  b AS (SELECT g // 1024 AS g, sha256(string_agg(h, '' ORDER BY g)) AS h FROM (SELECT g AS g, h FROM a) GROUP BY g // 1024),
  c AS (SELECT sha256(string_agg(h, '' ORDER BY g)) AS digest FROM b) SELECT digest FROM c""")
def t20_registry_digest(t):
    """Order-sensitive digest of a table, hashed level by level."""
    return D.registry_digest(t.read("documents"), "doc_id", "doc_id", "source", "lang")


@query("t21_scaffold_overlap", "WITH b AS (SELECT " + K.ascii_text("text") + " AS t FROM benchmark) " + " UNION ALL ".join(
    f"SELECT '{f}' AS family, {i} AS pattern_id, {K.q(p)} AS pattern, coalesce(bool_or(regexp_matches(t, {K.q(p)}, 'i')), false) AS dictated FROM b"
    for f, ps in lexicon(LEX).items() for i, p in enumerate(ps)))
def t21_scaffold_overlap(t):
    """Lexicon patterns that the benchmark prompts already contain."""
    return D.scaffold_overlap(t.read("benchmark"), "text", LEX)


RUBRIC = {"names figures": [r"\d+", r"\$"], "credits": [r"\bby\b", r"licen[sc]e"], "qualifies": [r"\bwas\b", r"\bwith\b", r"\best\b"]}


@query("t22_rubric_hits", f"{DOC} " + " UNION ALL ".join(
    f"SELECT source, '{r}' AS rubric, count(*) FILTER ({K.count('t', ps)} > 0) AS outputs, sum({K.count('t', ps)})::BIGINT AS hits FROM d GROUP BY 1"
    for r, ps in RUBRIC.items()))
def t22_rubric_hits(t):
    return D.rubric_hits(t.documents, "source", "text", RUBRIC)
