"""The estimators over data in which one group has no name: it is a group like any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import cards as C
from ledgerloom.operators import estimators as E
from ledgerloom.operators import pairs as D
from ledgerloom.plans import estimators as PE
from ledgerloom.plans.cards import CARDS, _num
from ledgerloom.plans.catalog import query, rounded

LEX = PE.LEX


def nameless(sql: str, column: str, source: str, value: str) -> str:
    """The oracle with the group `value` of `source AS column` held as '~' (as resampling keys name a null), null at the end."""
    held = sql.replace(f"{source} AS {column}", f"CASE WHEN {source} = '{value}' THEN '~' ELSE {source} END AS {column}")
    return f"SELECT * REPLACE (nullif({column}, '~') AS {column}) FROM ({held})"


_e11 = f"""{PE.BASE}, {PE.BON} SELECT condition, draws, round(independent, 6) AS independent,
  round(empirical, 6) AS empirical, cells, pooled FROM bon"""


@query("e11_nameless_group", nameless(_e11, "condition", "source", "src1"))
def e11_nameless_group(t):
    return rounded(E.best_of_n(t.audited().withColumn("condition", F.expr("nullif(condition, 'src1')"))))


@query("e20_nameless_group", nameless(PE._e20(), "writer_id", "lang", "fr"))
def e20_nameless_group(t):
    a = t.audited().where(~F.col("floor_guard")).withColumn("writer_id", F.expr("nullif(writer_id, 'fr')"))
    return rounded(E.cluster_slope(a, "prompt_id", "supply", "emitted", ["writer_id"]))


@query("e36_nameless_group", nameless(PE._e36().replace("SELECT lang, doc_id", "SELECT lang AS lang, doc_id", 1), "lang", "lang", "fr"))
def e36_nameless_group(t):
    d = t.documents.where(F.length("text") > 0).select(
        F.expr("nullif(lang, 'fr')").alias("lang"), "doc_id", (PE.X.total_count("text", LEX) / F.length("text") * 1000).alias("dn"))
    return rounded(E.mean_interval(d, ["lang"], ["doc_id"], "dn").select("lang", "n", "mean", "mean_lo", "mean_hi"), 5)


_e47 = f"{CARDS} SELECT condition, supplied, used, verdict, identifiable, worst_supply, n_needed, basis, {', '.join(f'round({c}, 6) AS {c}' for c in _num)} FROM cx"


@query("e47_nameless_group", nameless(_e47, "condition", "source", "src1"))
def e47_nameless_group(t):
    return rounded(C.parameter_cards(t.runs.withColumn("condition", F.expr("nullif(condition, 'src1')")), LEX))


@query("d16_remaining_results", """SELECT doc_id FROM documents WHERE doc_id NOT IN
  (SELECT doc_id FROM labels WHERE CASE WHEN doc_id % 3 > 0 THEN quality END IS NOT NULL OR nullif(toxic, 0) IS NOT NULL)""")
def d16_remaining_results(t):
    """Resume from a table of verdicts, some of them null: a document is due until one verdict is there."""
    done = t.read("labels").select("doc_id", F.expr("CASE WHEN doc_id % 3 > 0 THEN quality END").alias("quality"),
                                   F.expr("nullif(toxic, 0)").alias("toxic"))
    return D.remaining(t.read("documents").select("doc_id"), done, ["doc_id"])
