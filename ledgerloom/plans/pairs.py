"""Corpus and preference-pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon
from ledgerloom.operators import estimators as E
from ledgerloom.operators import pairs as D
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query, rounded
from ledgerloom.plans.detection import _caps, _grams, _words
from ledgerloom.plans.labels import LABELS, SENT, sentence_labels

LEX = "prose"
FAMS = list(lexicon(LEX))
W = f"WITH {K.DEALT}"
TR = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
MS = K.mask(K.ascii_text("s"), LEX)


def _ablated(text: str, bad: str) -> str:
    """Sentences of `text` for which the mask does not meet `bad`, joined; unchanged when nothing meets it."""
    ss = K.sents(text)
    m = K.mask(K.ascii_text("x"), LEX)
    return (f"CASE WHEN ({K.mask(K.ascii_text(text), LEX)} & {bad}) = 0 THEN {text} ELSE "
            f"{TR.format(f'''array_to_string(list_transform(list_filter({ss}, lambda x: ({m} & {bad}) = 0), lambda x: {TR.format('x')}), ' ')''')} END")


@query("d1_ablate", f"SELECT doc_id, md5({_ablated('text', '63')}) AS all_gone, length({_ablated('text', '63')})::INT AS chars FROM documents")
def d1_ablate(t):
    d = D.ablate(t.documents, "text", LEX)
    return d.select("doc_id", F.md5("ablated").alias("all_gone"), F.length("ablated").alias("chars"))


@query("d1_ablate_named", f"SELECT doc_id, md5({_ablated('text', str((1 << FAMS.index('agent')) | (1 << FAMS.index('stative'))))}) AS kept FROM documents")
def d1_ablate_named(t):
    d = t.documents.withColumn("drop", F.array(F.lit("agent"), F.lit("stative")))
    return D.ablate(d, "text", LEX, drop="drop").select("doc_id", F.md5("ablated").alias("kept"))


def _variants_sql(src: str = "runs") -> str:
    """Rows run_id, prompt_id, kept, variant parts and their families, families removed in name order."""
    order = sorted((f, i) for i, f in enumerate(FAMS))
    # drop mask when `kept` of the present families (in name order) stay: presence rank decides
    parts = []
    for n, (f, i) in enumerate(order):
        before = " + ".join([f"((m & {1 << j}) <> 0)::INT" for _, j in order[:n]] or ["0"])
        parts.append(f"(CASE WHEN (m & {1 << i}) <> 0 AND ({before}) >= k THEN {1 << i} ELSE 0 END)")
    drop = " + ".join(parts)
    return f"""vm AS MATERIALIZED (SELECT run_id, prompt_id, alpha, beta, gamma, {K.mask(K.ascii_text('up'), LEX)} AS m FROM {src}),
  vk AS (SELECT *, unnest(range(0, (bit_count(m)::INT + 1)::BIGINT))::INT AS k FROM vm), vd AS (SELECT *, ({drop})::INT AS dm FROM vk),
  va AS MATERIALIZED (SELECT run_id, prompt_id, k AS kept, {', '.join(f'{_ablated(c, "dm")} AS {c}' for c in ('alpha', 'beta', 'gamma'))} FROM vd),
  vf AS MATERIALIZED (SELECT *, {' | '.join(K.mask(K.ascii_text(c), LEX) for c in ('alpha', 'beta', 'gamma'))} AS fm FROM va)"""


_VOUT = f"kept, md5(concat_ws('|', alpha, beta, gamma)) AS variant, {K.names('fm', LEX)} AS families, bit_count(fm)::INT AS supply"


@query("d2_supply_variants", f"{W}, {_variants_sql()} SELECT run_id, {_VOUT} FROM vf")
def d2_supply_variants(t):
    v = D.supply_variants(t.runs, LEX, ["run_id"])
    return v.select("run_id", "kept", F.md5(F.array_join("variant", "|")).alias("variant"), F.array_join("families", ",").alias("families"), "supply")


_FIRST = "fr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY run_id) AS r FROM runs) WHERE r = 1)"


@query("d3_build_corpus", f"{W}, {_FIRST}, {_variants_sql('fr')} SELECT prompt_id, run_id, {_VOUT} FROM vf WHERE length(alpha) + length(beta) + length(gamma) >= 200")
def d3_build_corpus(t):
    v = D.build_corpus(t.runs, LEX)
    return v.select("prompt_id", "run_id", "kept", F.md5(F.array_join("variant", "|")).alias("variant"), F.array_join("families", ",").alias("families"), "supply")


@query("d3_decorrelation", f"""{W}, {_FIRST}, {_variants_sql('fr')}, it AS (SELECT prompt_id, bit_count(fm)::INT AS s FROM vf WHERE length(alpha) + length(beta) + length(gamma) >= 200),
  j AS (SELECT prompt_id, s, count(*) AS c FROM it GROUP BY 1, 2), pm AS (SELECT prompt_id, sum(c) AS a FROM j GROUP BY 1), sm AS (SELECT s, sum(c) AS b FROM j GROUP BY 1), n AS (SELECT sum(c) AS n, count(DISTINCT prompt_id) AS n_prompts FROM j),
  mi AS (SELECT sum(c / n::DOUBLE * ln(c::DOUBLE * n / (a * b)::DOUBLE)) AS mi FROM j JOIN pm USING (prompt_id) JOIN sm USING (s) CROSS JOIN n),
  h AS (SELECT -sum(b / n::DOUBLE * ln(b / n::DOUBLE)) AS hs, max(b) AS big, min(b) AS small, count(*) AS levels FROM sm CROSS JOIN n)
  SELECT n::BIGINT AS n_items, n_prompts, levels, round(mi / hs, 6) AS nmi, mi / hs < 0.15 AS balanced, big > 3 * greatest(1, small) AS imbalanced, n < 1000 AS small FROM n CROSS JOIN mi CROSS JOIN h""")
def d3_decorrelation(t):
    """Does topic still predict supply after the corpus was built?"""
    return rounded(E.decorrelation(D.build_corpus(t.runs, LEX)))


_seats = " UNION ALL ".join(f"SELECT prompt_id, run_id, '{s}' AS seat, unnest({K.sents(s)}) AS s, generate_subscripts({K.sents(s)}, 1) - 1 AS pos FROM runs" for s in ("alpha", "beta", "gamma"))
_BANK = f"""ss AS MATERIALIZED (SELECT *, {MS} AS m FROM ({_seats}) WHERE length(s) BETWEEN 40 AND 400),
  bk AS MATERIALIZED (SELECT prompt_id, m, arg_min(s, (run_id, seat, pos)) AS s FROM ss WHERE bit_count(m) = 1 GROUP BY 1, 2)"""
_fam = "CASE m " + " ".join(f"WHEN {1 << i} THEN '{f}'" for i, f in enumerate(FAMS)) + " END"


def _bank(t):
    s = X.explode_rows(t.seats, ["prompt_id", "run_id", "seat"], X.sentences("text"), "pos", "s")
    return D.injection_bank(s, "prompt_id", ["run_id", "seat", "pos"], "s", LEX)


@query("d4_injection_bank", f"{W}, {_BANK} SELECT prompt_id, {_fam} AS family, s AS sentence FROM bk")
def d4_injection_bank(t):
    return _bank(t)


@query("d4_inject_variants", f"""{W}, {_BANK}, up1 AS (SELECT run_id, prompt_id, up, {K.mask(K.ascii_text('up'), LEX)} AS have FROM runs),
  ms AS (SELECT u.run_id, u.prompt_id, up, {_fam.replace('CASE m', 'CASE b.m')} AS family, s, row_number() OVER (PARTITION BY u.run_id ORDER BY b.m) AS step FROM up1 u JOIN bk b ON b.prompt_id = u.prompt_id AND (u.have & b.m) = 0),
  ac AS (SELECT prompt_id, run_id, step, string_agg(family, '+') OVER w AS injected, up || string_agg(chr(10) || chr(10) || s, '') OVER w AS variant FROM ms WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT prompt_id, run_id, step::INT AS step, injected, md5(variant) AS variant, bit_count({K.mask(K.ascii_text('variant'), LEX)})::INT AS supply FROM ac""")
def d4_inject_variants(t):
    runs = t.dealt.select("run_id", "prompt_id", F.array_join(F.filter(F.array("alpha", "beta", "gamma"), lambda x: x != ""), "\n\n").alias("up"))
    v = D.inject_variants(runs, _bank(t), "prompt_id", "run_id", LEX)
    return v.withColumn("variant", F.md5("variant"))


@query("d5_ablate_labelled", f"""{LABELS}, fl AS (SELECT doc_id, pos, bool_or(CASE WHEN b IS NOT NULL THEN a AND b END) AS flag FROM lb GROUP BY 1, 2), j AS (SELECT se.doc_id, se.pos, s, flag FROM se LEFT JOIN fl USING (doc_id, pos))
  SELECT doc_id, md5(coalesce(string_agg(CASE WHEN NOT coalesce(flag, false) THEN {TR.format('s')} END, ' ' ORDER BY pos), '')) AS ablated, count(*) FILTER (flag) AS removed, count(*) FILTER (flag IS NULL) AS unlabelled, count(*) AS sentences FROM j GROUP BY 1""")
def d5_ablate_labelled(t):
    """Sentences both judges flag are taken out; unlabelled ones stay and are counted."""
    p = sentence_labels(t).groupBy("doc_id", "pos", "family").agg(
        F.every(F.col("value")).alias("both"), F.count_if(F.col("value").isNull()).alias("lost"))
    flags = p.groupBy("doc_id", "pos").agg(F.bool_or(F.when(F.col("lost") == 0, F.col("both"))).alias("flag"))
    d = D.ablate_labelled(t.sentences.select("doc_id", "pos", "s"), flags, "doc_id", "pos", "s")
    return d.withColumn("ablated", F.md5("ablated"))


_RF = f"rf AS MATERIALIZED (SELECT run_id, output, {K.mask(K.ascii_text('alpha'), LEX)} AS tm, {K.mask(K.ascii_text('output'), LEX)} AS om FROM runs)"


def _refs(t):
    return t.dealt.select("run_id", "output", X.families("alpha", LEX).alias("target"))


@query("d6_verify_reference", f"{W}, {_RF} SELECT run_id, {K.names(K.minus('tm', 'om'), LEX)} AS missing, {K.names(K.minus('om', 'tm'), LEX)} AS unsourced, tm = om AS ok FROM rf")
def d6_verify_reference(t):
    v = D.verify_reference(_refs(t), "target", "output", LEX)
    return v.select("run_id", F.array_join("missing", ",").alias("missing"), F.array_join("unsourced", ",").alias("unsourced"), "ok")


def _drop_sql() -> str:
    """Sentence offsets from the boundary rule: pieces with their separators, walked by cumulative length."""
    seg = "string_split(regexp_replace(regexp_replace(output, '([.!?])(\\s+)', '\\1' || chr(30) || '\\2' || chr(31), 'g'), '(^|[^\\x1e\\s])(\\n+)', '\\1' || chr(30) || '\\2' || chr(31), 'g'), chr(31))"
    return f"""sg AS (SELECT run_id, output, tm, unnest({seg}) AS p, generate_subscripts({seg}, 1) AS i FROM rf),
  sl AS (SELECT run_id, output, tm, i, string_split(p, chr(30))[1] AS s, length(replace(p, chr(30), '')) AS n FROM sg),
  so AS MATERIALIZED (SELECT run_id, output, tm, s, coalesce(sum(n) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM sl),
  sm AS (SELECT *, {MS} & tm AS m FROM so WHERE s <> '')"""


_dropf = " UNION ALL ".join(f"SELECT run_id, '{f}' AS family, arg_min(s, st) AS s, min(st) AS st, any_value(output) AS output FROM sm WHERE (m & {1 << i}) <> 0 GROUP BY run_id" for i, f in enumerate(FAMS))


@query("d7_drop_pairs", f"""{W}, {_RF}, {_drop_sql()}, fs AS ({_dropf}), pr AS (SELECT run_id, family, output, {TR.format("substr(output, 1, st) || substr(output, st + length(s) + 1)")} AS rejected, st, st + length(s) AS en FROM fs)
  SELECT run_id, family, md5(output) AS chosen, md5(rejected) AS rejected, st::INT AS span_start, en::INT AS span_end FROM pr WHERE length(rejected) >= 200""")
def d7_drop_pairs(t):
    p = D.drop_pairs(_refs(t), "output", "target", LEX, ["run_id"])
    span = F.get("chosen_spans", F.lit(0))
    return p.select("run_id", "family", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), span["start"].alias("span_start"), span["end"].alias("span_end"))


INJ = {"figure": "It fell by 42 points.", "linking": "This came with caveats.", "stative": "That was assumed."}


@query("d8_invention_pairs", f"""{W}, {_RF}, {_drop_sql()}, fs AS (SELECT run_id, st, row_number() OVER (PARTITION BY run_id ORDER BY st) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM so WHERE s <> ''),
  at1 AS (SELECT run_id, st FROM fs WHERE r = least(2, n)), x AS ({' UNION ALL '.join(f"SELECT run_id, '{f}' AS family, {K.q(s)} AS inj FROM rf WHERE (tm & {1 << FAMS.index(f)}) = 0" for f, s in INJ.items())})
  SELECT x.run_id, family, md5(output) AS chosen, md5(substr(output, 1, st) || inj || ' ' || substr(output, st + 1)) AS rejected, st::INT AS span_start, (st + length(inj))::INT AS span_end
  FROM x JOIN at1 USING (run_id) JOIN rf USING (run_id)""")
def d8_invention_pairs(t):
    p = D.invention_pairs(_refs(t), "output", "target", INJ, LEX, ["run_id"])
    span = F.get("rejected_spans", F.lit(0))
    return p.select("run_id", "family", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), span["start"].alias("span_start"), span["end"].alias("span_end"))


def _minimal(t):
    p = D.drop_pairs(_refs(t), "output", "target", LEX, ["run_id"])
    return D.diagnose_pairs(p, LEX, ["run_id", "family"])


@query("d9_diagnose_pairs")
def d9_diagnose_pairs(t):
    """What differs within every drop pair (unit tests hold known cases)."""
    return rounded(_minimal(t))


@query("d9_spliced_pairs", f"""WITH w AS (SELECT doc_id, regexp_extract_all({K.ascii_text('text')}, '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents), p AS (SELECT doc_id, len(ws) AS n, ws, [2, n // 2 + 1, n - 1] AS places FROM w WHERE n >= 8),
  r AS (SELECT doc_id, n, array_to_string(ws, ' ') AS a, array_to_string(list_transform(ws, lambda x, i: CASE WHEN list_contains(places, i) THEN 'qqq' || i ELSE x END), ' ') AS b FROM p)
  SELECT doc_id, round(6 / (2 * n)::DOUBLE, 6) AS differing, round(length(a) / length(b)::DOUBLE, 6) AS length_ratio, CASE WHEN {K.mask('a', LEX)} | {K.mask('b', LEX)} = 0 THEN 1.0::DOUBLE END AS off_feature FROM r""")
def d9_spliced_pairs(t):
    """Texts against themselves with three words replaced, near both ends and in the middle."""
    ascii_ = F.when(F.octet_length("text") == F.length("text"), F.col("text")).otherwise(F.regexp_replace("text", "[^\\x00-\\x7f]", "z"))
    w = X.held(t.documents.select("doc_id", "text"), "ws", F.regexp_extract_all(ascii_, F.lit("[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0))).where(F.size("ws") >= 8)
    n = F.size("ws")

    def edited(*places):
        """The words joined, with those at some places (ascending, from 0, none next to another or first) replaced."""
        parts, at = [], F.lit(0)
        for i in places:
            parts += [F.array_join(F.slice("ws", at + 1, i - at), " "), F.concat(F.lit("qqq"), i + 1)]
            at = i + 1
        return F.concat_ws(" ", *parts, F.array_join(F.slice("ws", at + 1, n - at), " "))
    edit = edited(F.lit(1), F.floor(n / 2).cast("int"), n - 2)
    p = X.held(w, "p", F.struct(F.array_join("ws", " ").alias("chosen"), edit.alias("rejected"))).select("doc_id", "p.*")
    d = D.diagnose_pairs(p.withColumn("m", X.families_mask("chosen", LEX).bitwiseOR(X.families_mask("rejected", LEX))), LEX, ["doc_id", "m"])
    return rounded(d.select("doc_id", "differing", "length_ratio", F.when(F.col("m") == 0, F.col("off_feature")).alias("off_feature")))


@query("d10_diagnose_set")
def d10_diagnose_set(t):
    """Medians over the drop pairs per family."""
    return rounded(D.diagnose(_minimal(t), ["family"]))


@query("d11_feature_mask", f"""{W}, {_RF}, {_drop_sql().replace('& tm AS m', 'AS m')}, mk AS (SELECT run_id, st, st + length(s) AS en, s FROM sm WHERE m <> 0)
  SELECT run_id, count(*)::INT AS spans, sum(en - st)::BIGINT AS chars, sum(len(regexp_extract_all(s, '\\S+')))::BIGINT AS tokens_on FROM mk GROUP BY 1""")
def d11_feature_mask(t):
    """Sentence-level masks and the 0/1 token masks laid over them."""
    m = D.feature_mask(t.dealt.select("run_id", "output"), "output", LEX)

    pieces = F.split("output", r"(?<=\s)(?=\S)", -1)
    offsets = F.aggregate(
        pieces, F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("o")),
        lambda a, p: F.struct((a["pos"] + F.length(p)).alias("pos"), F.concat(a["o"], F.array(F.struct(
            a["pos"].alias("start"), (a["pos"] + F.length(F.regexp_replace(p, r"\s+$", ""))).alias("end")))).alias("o")))["o"]
    m = m.withColumn("_o", offsets)
    tm = D.token_mask("_o", "mask")
    return m.where(F.size("mask") > 0).select(
        "run_id", F.size("mask").alias("spans"), F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("chars"),
        F.aggregate(tm, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens_on"))


@query("d12_pair_gates", f"""{W}, p AS (SELECT run_id, output, gamma, length(output) / greatest(length(gamma), 1)::DOUBLE AS lr, bit_count({K.mask(K.ascii_text('output'), LEX)}) >= 2 AS enough,
    {K.total(K.ascii_text('gamma'), LEX)} AS r1, {K.total(K.ascii_text('gamma'), 'prose_loose')} AS r2, {_caps('output')} AS a, {_caps('gamma')} AS b FROM (SELECT run_id, alpha AS output, gamma FROM runs))
  SELECT run_id, round(lr, 6) AS length_ratio, enough AND r1 = 0 AND lr BETWEEN 0.8 AND 1.3 AS pass_original, enough AND r2 = 0 AND lr BETWEEN 0.8 AND 1.4
   AND CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE ELSE 1 END >= 0.35 AS pass_amended FROM p""")
def d12_pair_gates(t):
    p = t.dealt.select("run_id", F.col("alpha").alias("chosen"), F.col("gamma").alias("rejected"), X.families("alpha", LEX).alias("fams"))
    return rounded(D.pair_gates(p, "fams", LEX, "prose_loose").select("run_id", "length_ratio", "pass_original", "pass_amended"))


def _sm(c, i):
    a = K.ascii_text(c)
    return f"SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'heavy' ELSE 'light' END AS label, {i} AS sample, {c} AS tx, CASE WHEN length({c}) > 0 THEN {K.total(a, LEX)} / length({c})::DOUBLE * 1000 ELSE 0 END AS de, bit_count({K.mask(a, LEX)})::INT AS k, CASE WHEN length({c}) > 0 THEN {K.total(a, 'prose_loose')} / length({c})::DOUBLE * 1000 ELSE 0 END AS d2 FROM runs"


@query("d13_extreme_pairs", f"""{W}, s AS ({' UNION ALL '.join(_sm(c, i) for i, c in enumerate(('alpha', 'beta', 'gamma')))}), r AS (SELECT *, round(CASE WHEN label = 'heavy' THEN de * sqrt(k / 6::DOUBLE) ELSE -de END, 9) AS rw FROM s),
  q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rw, sample) AS lo, row_number() OVER (PARTITION BY run_id ORDER BY rw DESC, sample DESC) AS hi FROM r),
  p AS (SELECT b.label, b.rw - w.rw AS mg, length(b.tx) / greatest(length(w.tx), 1)::DOUBLE AS lr, b.d2 AS bd, w.d2 AS wd FROM q b JOIN q w ON w.run_id = b.run_id AND w.lo = 1 WHERE b.hi = 1)
  SELECT label, CASE WHEN mg < 0.1 THEN 'margin' WHEN NOT lr BETWEEN 0.8 AND 1.4 THEN 'ratio' WHEN CASE WHEN label = 'heavy' THEN bd < wd ELSE bd > wd END THEN 'second instrument' ELSE 'kept' END AS gate, count(*) AS n, round(avg(mg), 6) AS mean_margin FROM p GROUP BY 1, 2""")
def d13_extreme_pairs(t):
    s = t.dealt.select("run_id", F.when(F.col("run_id") % 2 == 0, "heavy").otherwise("light").alias("label"), F.posexplode(F.array("alpha", "beta", "gamma")).alias("sample", "text"))
    e = D.extreme_pairs(s, "run_id", "label", "text", LEX, "prose_loose")
    return rounded(e.groupBy("label", "gate").agg(F.count("*").alias("n"), F.avg("margin").alias("mean_margin")))


@query("d14_preservation_reward", f"""{W}, w AS MATERIALIZED (SELECT run_id, length(output) AS n, {_words('output')} AS a, {_words("concat_ws(' ', alpha, beta, gamma)")} AS b, concat_ws('', alpha, beta, gamma) <> '' AS has,
     {K.mask(K.ascii_text('output'), LEX)} AS om, {K.mask(K.ascii_text("concat_ws(' ', alpha, beta, gamma)"), LEX)} AS um FROM runs),
  g AS MATERIALIZED (SELECT *, {_grams('a', 8)} AS g8, {_grams('b', 8)} AS s8, {_grams('a', 5)} AS g5 FROM w),
  h AS (SELECT run_id, n, len(list_intersect(g8, s8)) / greatest(len(g8), 1)::DOUBLE AS ov, len(g5) / greatest(len(a) - 4, 1)::DOUBLE AS dr, bit_count(um)::INT AS raised, bit_count(um & om)::INT AS kept, bit_count({K.minus('om', 'um')})::INT AS extra FROM g)
  SELECT run_id, round(ov, 6) AS overlap, round(dr, 6) AS distinct_ratio, round(CASE WHEN n < 400 OR n > 8000 OR ov > 0.35 OR dr < 0.45 THEN -1.0 ELSE kept / greatest(raised, 1)::DOUBLE - 0.5 * extra / 4.0 - 0.5 * greatest(0, ov - 0.15) / 0.2 END, 6) AS reward FROM h""")
def d14_preservation_reward(t):
    d = t.dealt.select("run_id", "output", F.trim(F.concat_ws(" ", "alpha", "beta", "gamma")).alias("src"))
    return rounded(D.preservation_reward(d, "output", "src", LEX, ["run_id"], lengths=(400, 8000)))


@query("d15_split", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) AS rank, count(*) OVER () AS n FROM documents), k AS (SELECT *, greatest(4, n // 20) AS k FROM r)
  SELECT doc_id, CASE WHEN rank <= k THEN 'valid' WHEN rank <= 2 * k THEN 'test' ELSE 'train' END AS split FROM k""")
def d15_split(t):
    """Seeded split of all documents, ranked without a global window."""
    return D.split(t.read("documents").select("doc_id"), "doc_id")


@query("d16_dedup_sentences", f"{SENT} SELECT min((doc_id, pos)).doc_id AS doc_id, count(*) AS copies, md5(arg_min(s, (doc_id, pos))) AS sentence FROM (SELECT doc_id, pos, s, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS k FROM se) GROUP BY md5(k)".replace("min((doc_id, pos)).doc_id", "arg_min(doc_id, (doc_id, pos))"))
def d16_dedup_sentences(t):
    """First occurrence of every normalised sentence (whole sentences, never prefixes)."""
    d = D.dedup(t.sentences, X.norm("s", "word"), ["doc_id", "pos"], ["doc_id", "s"])
    return d.select("doc_id", "copies", F.md5("s").alias("sentence"))


@query("d16_remaining", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def d16_remaining(t):
    """Resume: documents without a usable label yet."""
    return D.remaining(t.read("documents").select("doc_id"), t.read("labels").where("quality = 1").select("doc_id"), ["doc_id"])


TEMPLATES = {"brief": "Summarise {} in one line.", "audit": "Which claims about {} lack a source?"}


@query("d17_prompt_pool", "SELECT p_partkey, template, CASE template WHEN 'brief' THEN 'Summarise ' || p_name || ' in one line.' ELSE 'Which claims about ' || p_name || ' lack a source?' END AS prompt FROM part CROSS JOIN (VALUES ('brief'), ('audit')) v(template)")
def d17_prompt_pool(t):
    parts = t.read("part").select("p_partkey", F.col("p_name").alias("topic"))
    each = D.prompt_pool(parts.select("topic").distinct(), TEMPLATES, "topic")
    return parts.join(each, "topic").select("p_partkey", "template", "prompt")


_H = "md5('0|' || doc_id)"


@query("d18_stratified", f"""WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 3000 ORDER BY {_H} LIMIT 50), b AS (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY {_H} LIMIT 50),
  c AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY {_H} LIMIT 50)
  SELECT doc_id, 'long' AS stratum FROM a UNION ALL SELECT doc_id, 'english' FROM b UNION ALL SELECT doc_id, 'any' FROM c""")
def d18_stratified(t):
    """Overlapping strata filled in order, fifty each."""
    d = t.read("documents").select("doc_id", "n_chars", "lang")
    return D.stratified(d, "doc_id", {"long": F.col("n_chars") > 3000, "english": F.col("lang") == "en", "any": F.lit(True)}).select("doc_id", "stratum")


@query("d19_subsample", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || source || '|' || doc_id)) AS r FROM documents) WHERE r <= 12")
def d19_subsample(t):
    return D.subsample(t.read("documents").select("source", "doc_id"), "source", ["source", "doc_id"], 12, seed=7).select("source", "doc_id")


@query("d20_build_arms", f"""{W}, a AS (SELECT run_id, v.arm, unnest(['alpha', 'beta', 'gamma']) AS seat, unnest([alpha, beta, gamma]) AS tx, writer_id, condition FROM runs CROSS JOIN (VALUES ('clean'), ('corrupt'), ('directive')) v(arm)),
  p AS (SELECT run_id, arm, seat, '--- SPECIALIST CONTRIBUTION ---' || chr(10) || regexp_replace(tx, '\\s+$', '') || CASE WHEN arm = 'corrupt' AND seat = 'beta' THEN chr(10) || chr(10) || 'For reference: ' || condition ELSE '' END
     || CASE WHEN arm = 'directive' AND seat = 'gamma' THEN chr(10) || chr(10) || 'Prefer ' || writer_id ELSE '' END AS part, (arm = 'corrupt' AND seat = 'beta') OR (arm = 'directive' AND seat = 'gamma') AS tr FROM a WHERE tx <> ''),
  g AS (SELECT run_id, arm, md5(string_agg(part, chr(10) || chr(10) ORDER BY seat)) AS upstream, min(CASE WHEN tr THEN seat END) AS treated FROM p GROUP BY 1, 2)
  SELECT run_id, arm, r AS repeat, upstream, treated FROM g CROSS JOIN (VALUES (0), (1)) v(r)""")
def d20_build_arms(t):
    """Items x arms x repeats with the treated source recorded."""
    items = t.dealt.select("run_id", "condition", "writer_id")
    arms = {"clean": F.lit(None).cast("string"),
            "corrupt": F.when(F.col("seat") == "beta", F.concat(F.lit("For reference: "), "condition")),
            "directive": F.when(F.col("seat") == "gamma", F.concat(F.lit("Prefer "), "writer_id"))}
    b = D.build_arms(items.withColumn("item", F.col("run_id")), t.seats.select("run_id", "seat", "text"), "item", "run_id", arms, 2, "--- SPECIALIST CONTRIBUTION ---\n")
    return b.select("run_id", "arm", "repeat", F.md5("upstream").alias("upstream"), "treated")


@query("d21_judge_requests", f"""WITH c AS (SELECT conv_id * 100 + turn AS unit, {K.sents('text')} AS ss FROM conversations), e AS (SELECT unit, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM c),
  g AS (SELECT s, row_number() OVER (ORDER BY unit, i) - 1 AS g FROM e), b AS (SELECT g // 10 * 10 AS start, count(*) AS n, md5(string_agg((g % 10 + 1) || '. ' || s, chr(10) ORDER BY g)) AS body FROM g GROUP BY 1)
  SELECT start::BIGINT AS start, n::INT AS n, body, j AS judge FROM b CROSS JOIN (VALUES ('one'), ('two')) v(j)""")
def d21_judge_requests(t):
    u = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("unit"), X.sentences("text").alias("ss"))
    r = D.judge_requests(u, "unit", "ss", ["one", "two"])
    return r.select(F.col("start").cast("bigint").alias("start"), "n", F.md5("body").alias("body"), "judge")
