"""Exact order statistics without a global sort in one task.

Values are counted, and running totals are taken over a tree on the bits of the values (`functions.prefix`), so any spread
of values does. Nothing is sampled or approximated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import stats as S
from ledgerloom.functions.groups import join_groups
from ledgerloom.functions.prefix import below, sortable


def running(df: DataFrame, by: Sequence[str], value: str, counts: Sequence[str]) -> DataFrame:
    """Sum `counts` per distinct value; add <count>_below, the total over smaller values, and <count>_all."""
    by = list(by)
    # nulls are dropped by a counted aggregate: a filter on the value itself would be pushed down and make
    # a costly value expression run twice
    dist = df.groupBy(*by, value).agg(*[F.sum(x).alias(x) for x in counts], F.count(value).alias("_c")).where("_c > 0").drop("_c")
    return below(dist, by, sortable(value), counts, [value])


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float | str]) -> DataFrame:
    """Nearest-rank quantiles (banker's rounding of q (n - 1)), 'median' (mean of the middle two), and the
    count of zeros, in one pass over the values."""
    by = list(by)
    ranked = running(df.withColumn("_n", F.lit(1)), by, value, ["_n"])
    total = F.col("_n_all")

    def at(rank):
        inside = (rank >= F.col("_n_below")) & (rank < F.col("_n_below") + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    out = []
    for name, q in qs.items():
        if q == "median":
            out.append(((at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2).alias(name))
        else:
            out.append(at(F.bround(F.lit(q) * (total - 1), 0)).alias(name))
    zeros = F.coalesce(F.max(F.when(F.col(value) == 0, F.col("_n"))), F.lit(0))
    return ranked.groupBy(*by).agg(F.max(total).alias("n"), zeros.alias("zeros"), *out)


def many_quantiles(df: DataFrame, by: Sequence[str], qs: dict[str, dict[str, float | str]]) -> DataFrame:
    """Quantiles of several columns in one pass: the columns are laid under each other, ranked, and set back.

    qs  column -> {output name: q}; also <column>_zeros
    """
    by = list(by)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("_metric"), F.col(c).cast("double").alias("_v")) for c in qs]))
    long = df.select(*by, rows.alias("_e")).select(*by, "_e.*")
    wanted = {}
    for spec in qs.values():
        wanted.update({f"q_{v}": v for v in spec.values()})
    q = quantiles(long, [*by, "_metric"], "_v", wanted)
    out = [F.max("n").alias("n")]
    for c, spec in qs.items():
        on = F.col("_metric") == c
        out += [F.max(F.when(on, F.col("zeros"))).alias(f"{c}_zeros")]
        out += [F.max(F.when(on, F.col(f"`q_{v}`"))).alias(name) for name, v in spec.items()]
    return q.groupBy(*by).agg(*out)


def auc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is missing."""
    marked = df.where(F.col(label).isNotNull()).withColumn("_pos", F.col(label).cast("int")).withColumn(
        "_neg", 1 - F.col("_pos"))
    r = running(marked, by, score, ["_pos", "_neg"])
    wins = F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0))
    p, n = F.sum("_pos"), F.sum("_neg")
    return r.groupBy(*by).agg(p.alias("n_pos"), n.alias("n_neg"),
                              F.when((p > 0) & (n > 0), wins / (p * n)).alias("auc"))


def youden(df: DataFrame, by: Sequence[str], label: str, score: str, min_class: int = 5) -> DataFrame:
    """Cut (score rounded to four places, flag when score >= cut) with the highest J; lowest cut on ties.

    The candidates are all rounded scores plus 0 and 1.
    """
    marked = df.where(F.col(label).isNotNull()).withColumn("_pos", F.col(label).cast("int")).withColumn("_neg", 1 - F.col("_pos"))
    by = list(by)
    # every rounded score is a candidate; a score counts as flagged when it is not below the candidate
    scores = marked.groupBy(*by, score).agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.count(score).alias("_c")).where("_c > 0").drop("_c")
    tot = scores.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
    cands = scores.select(*by, F.round(score, 4).alias("_v"), F.lit(0).alias("_pos"), F.lit(0).alias("_neg"),
                          F.lit(1).alias("_cand")).distinct()
    ends = tot.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("_v"), F.lit(0).alias("_pos"),
                      F.lit(0).alias("_neg"), F.lit(1).alias("_cand"))
    points = scores.select(*by, F.col(score).alias("_v"), "_pos", "_neg", F.lit(0).alias("_cand")).unionByName(
        cands).unionByName(ends)
    r = running(points, by, "_v", ["_pos", "_neg", "_cand"]).where("_cand > 0")
    r = r.withColumnsRenamed({"_pos_all": "_p", "_neg_all": "_q"})
    usable = (F.col("_p") >= min_class) & (F.col("_q") >= min_class)
    j = F.when(usable, (F.col("_p") - F.col("_pos_below")) / F.col("_p")
               - (F.col("_q") - F.col("_neg_below")) / F.col("_q"))
    r = r.withColumn("_j", F.round(j, 12))
    best = F.max(F.struct("_j", (-F.col("_v")).alias("v")))
    return r.groupBy(*by).agg(F.max("_p").alias("n_pos"), F.max("_q").alias("n_neg"), best.alias("b")).select(
        *by, "n_pos", "n_neg", F.when(F.col("b._j").isNotNull(), -F.col("b.v")).alias("cut"),
        F.col("b._j").alias("j"))


def youden_grid(df: DataFrame, by: Sequence[str], label: str, score: str, step: int = 5, min_class: int = 5) -> DataFrame:
    """As `youden`, with the candidates step, 2 step, ... percent below 100; one pass, two bounded sums per candidate.

    Rows without a label or score are left out; a class of fewer than `min_class` gives no cut.
    """
    by, cuts = list(by), [i / 100 for i in range(step, 100, step)]
    marked = df.select(*by, F.col(label).cast("int").alias("_y"), F.col(score).alias("_s"))
    known = F.col("_y").isNotNull() & F.col("_s").isNotNull()

    def hits(y, i):
        return F.count_if(known & (F.col("_y") == y) & (F.col("_s") >= F.lit(cuts[i])))
    sums = marked.groupBy(*by).agg(
        F.count_if(known & (F.col("_y") == 1)).alias("n_pos"), F.count_if(known & (F.col("_y") == 0)).alias("n_neg"),
        F.array(*[hits(1, i) for i in range(len(cuts))]).alias("_t"), F.array(*[hits(0, i) for i in range(len(cuts))]).alias("_f"))
    points = F.array(*[F.struct(
        F.round(F.get("_t", F.lit(i)) / F.col("n_pos") - F.get("_f", F.lit(i)) / F.col("n_neg"), 12).alias("j"), F.lit(-c).alias("v"))
        for i, c in enumerate(cuts)])
    usable = (F.col("n_pos") >= max(min_class, 1)) & (F.col("n_neg") >= max(min_class, 1))
    best = sums.withColumn("b", F.when(usable, F.array_max(points)))
    return best.select(*by, "n_pos", "n_neg", (-F.col("b.v")).alias("cut"), F.col("b.j").alias("j"))


def calibrate(scored: DataFrame, family: str, domain: str, order: str, label: str, score: str, cap: int = 150) -> DataFrame:
    """AUC and Youden cut per family from the first `cap` labelled units of each domain (a group-limited top-k)."""
    rank = F.row_number().over(Window.partitionBy(family, domain).orderBy(order))
    kept = scored.where(F.col(label).isNotNull()).withColumn("_r", rank).where(F.col("_r") <= cap)
    a = auc(kept, [family], label, score)
    y = youden(kept, [family], label, score).select(family, "cut", "j")
    return a.join(y, family)


def spearman(table: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of two columns, average ranks on ties; null when either is constant.

    Rows are counted by (x, y) first. Ranks are taken about their mean, so that large tables keep their digits.
    """
    by = list(by)
    pairs = table.groupBy(*by, x, y).agg(F.count("*").alias("_n")).where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c, name):
        r = running(pairs, by, c, ["_n"])
        return r.select(*by, c, (F.col("_n_below") + F.col("_n") / 2.0 - F.col("_n_all") / 2.0).alias(name))
    both = join_groups(join_groups(pairs, ranks(x, "_rx"), [*by, x]), ranks(y, "_ry"), [*by, y])

    def weighted(a, b):
        return F.sum(F.col("_n") * F.col(a) * F.col(b))
    spread = F.sqrt(weighted("_rx", "_rx")) * F.sqrt(weighted("_ry", "_ry"))
    return both.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), S.ratio(weighted("_rx", "_ry"), spread).alias("rho"))
