"""Guards of items, arms and run files bound to the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import guards as G
from ledgerloom.plans import sqlkit as K
from ledgerloom.plans.catalog import query

WORDS = ["avec", "erly", "Eror"]
_PROBE = "list_filter([regexp_extract(output, '[A-Za-z]{7,}', 0), regexp_extract(gamma, '[A-Za-z]{7,}', 0)], lambda p: p <> '')"


def _sp(e):
    return f"regexp_replace(regexp_replace({e}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query("p16_item_guards", f"""WITH {K.DEALT}, i AS (SELECT *, {_PROBE} AS ps, lower({_sp('alpha')}) || chr(1) || lower({_sp('beta')}) AS prem,
    length(alpha) / greatest(length(beta), 1)::DOUBLE AS rt FROM runs),
  p AS (SELECT run_id, unnest(ps) AS p, prem FROM i)
  SELECT run_id, 'probe ''' || p || ''' occurs in its premises' AS violation FROM p WHERE contains(prem, lower(p))
  UNION ALL SELECT run_id, 'length ratio off' FROM i WHERE rt < 0.85 OR rt > 1.15
  UNION ALL SELECT run_id, 'one seat twice' FROM i WHERE run_id % 3 = prompt_id % 4
  UNION ALL SELECT run_id, 'route is not the seat' FROM i WHERE run_id % 5 <> prompt_id % 5 OR condition = writer_id
  UNION ALL SELECT run_id, 'domain word ''' || w || ''' in the task' FROM (SELECT run_id, gamma, unnest({[w.lower() for w in WORDS]}) AS w FROM i) WHERE contains(lower(gamma), w)""")
def p16_item_guards(t):
    """All guards of one item in one pass over its row."""
    def probe(c):
        return F.nullif(F.regexp_extract(c, "[A-Za-z]{7,}", 0), F.lit(""))

    v = G.violations(
        t.dealt, ["run_id"],
        G.probe_in_text(F.array(probe("output"), probe("gamma")), ["alpha", "beta"], "its premises"),
        G.length_ratio("alpha", "beta"),
        G.must_differ(F.col("run_id") % 3, F.col("prompt_id") % 4, "one seat twice"),
        G.must_agree(F.struct(F.col("run_id") % 5, F.col("condition") == F.col("writer_id")),
                     F.struct(F.col("prompt_id") % 5, F.lit(False)), "route is not the seat"),
        G.words_in_text("gamma", WORDS))
    return v.withColumn("violation", F.when(F.startswith("violation", F.lit("length ratio")), "length ratio off").otherwise(F.col("violation")))


@query("p16_arm_forms", """WITH a AS (SELECT doc_id, 'X' AS arm, text || ' <' || source || '>' AS prompt, '<' || source || '>' AS form FROM documents
    UNION ALL SELECT doc_id, 'Y', text || ' <' || lang || '>' || CASE WHEN doc_id % 10 = 0 THEN '!' ELSE '' END, '<' || lang || CASE WHEN doc_id % 7 = 0 THEN '?>' ELSE '>' END FROM documents),
  g AS (SELECT doc_id, count(DISTINCT replace(prompt, form, chr(1))) AS n FROM a GROUP BY 1)
  SELECT doc_id, 'arm ''' || arm || ''' lacks its own form' AS violation FROM a WHERE NOT contains(prompt, form)
  UNION ALL SELECT doc_id, 'prompts differ by more than the form' FROM g WHERE n > 1""")
def p16_arm_forms(t):
    """Two arms a document, which may differ in the name they are given and in nothing else."""
    d, i = t.read("documents"), F.col("doc_id")

    def tag(c, end=None):
        return F.concat(F.lit("<"), F.col(c), end if end is not None else F.lit(">"))

    x = d.select("doc_id", F.lit("X").alias("arm"), F.concat_ws(" ", "text", tag("source")).alias("prompt"), tag("source").alias("form"))
    y = d.select("doc_id", F.lit("Y").alias("arm"), F.concat(F.concat_ws(" ", "text", tag("lang")), F.when(i % 10 == 0, "!").otherwise("")).alias("prompt"),
                 tag("lang", F.when(i % 7 == 0, "?>").otherwise(">")).alias("form"))
    return G.differ_beyond_form(x.unionByName(y), ["doc_id"], "arm")


@query("p18_files", f"""WITH e AS (SELECT (doc_id + (doc_id % 13 = 0)::INT) || CASE WHEN doc_id % 29 = 0 THEN '' ELSE '__' || lang END AS stem, doc_id, lang, doc_id % 23 = 0 AS bad,
    CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE lang END AS mode, CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'cell2-seed' ELSE source END AS model,
    length(trim(substr(text, 1, doc_id % 200), chr(32) || chr(9) || chr(10) || chr(13))) AS n FROM documents)
  SELECT stem AS run_id, 'unreadable' AS violation FROM e WHERE bad
  UNION ALL SELECT stem, 'file name is not <case>__<mode>' FROM e WHERE NOT bad AND doc_id % 29 = 0
  UNION ALL SELECT stem, 'case differs from the file name' FROM e WHERE NOT bad AND doc_id % 29 <> 0 AND doc_id % 13 = 0
  UNION ALL SELECT stem, 'mode differs from the file name' FROM e WHERE NOT bad AND doc_id % 29 <> 0 AND doc_id % 17 = 0
  UNION ALL SELECT stem, 'output under 50 characters' FROM e WHERE NOT bad AND n < 50
  UNION ALL SELECT stem, 'no model' FROM e WHERE NOT bad AND model = ''
  UNION ALL SELECT stem, 'batch tag in the model field' FROM e WHERE NOT bad AND model = 'cell2-seed'""")
def p18_files(t):
    """Run files named after documents, with planted faults of each kind."""
    i, lang = F.col("doc_id"), F.col("lang")
    e = t.read("documents").select(
        F.concat((i + (i % 13 == 0).cast("int")).cast("string"), F.when(i % 29 == 0, "").otherwise(F.concat(F.lit("__"), lang))).alias("run_id"),
        F.when(i % 23 == 0, "{").alias("_corrupt_record"), i.alias("case_id"), F.when(i % 17 == 0, "other").otherwise(lang).alias("mode"),
        F.when(i % 31 == 0, "").when(i % 19 == 0, "cell2-seed").otherwise(F.col("source")).alias("model"),
        F.substring(F.col("text"), F.lit(1), (i % 200).cast("int")).alias("final_output"))
    return G.file_violations(e)


@query("p18_gaps", f"""WITH {K.DEALT}, w AS (SELECT DISTINCT condition, doc_id % 50 AS prompt_id FROM (SELECT source AS condition, doc_id + 1 AS doc_id FROM documents)),
  h AS (SELECT condition, prompt_id, count(*) AS n FROM runs GROUP BY ALL)
  SELECT w.condition, w.prompt_id, coalesce(n, 0) AS runs FROM w LEFT JOIN h ON w.condition = h.condition AND w.prompt_id = h.prompt_id WHERE coalesce(n, 0) < 5""")
def p18_gaps(t):
    """Cells of a design of arms and cases that hold fewer than five runs."""
    wanted = t.read("documents").select(F.col("source").alias("condition"), ((F.col("doc_id") + 1) % 50).alias("prompt_id"))
    return G.coverage_gaps(t.dealt, wanted, "condition", "prompt_id", 5)
