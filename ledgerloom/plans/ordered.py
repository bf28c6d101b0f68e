"""Order statistics where values spread over many powers of ten, and over tables of every size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import ranks as R
from ledgerloom.plans.catalog import query, rounded

_SCALED = """w AS (SELECT o_orderkey, o_custkey, o_orderstatus, s.scale, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * o_totalprice * s.f AS v, s.f
  FROM orders CROSS JOIN (VALUES ('big', 1e9::DOUBLE), ('small', 1e-9::DOUBLE)) s(scale, f)),
  m AS (SELECT *, 'mixed' AS g, 1.0::DOUBLE AS u FROM w UNION ALL SELECT *, scale, f FROM w)"""


def scaled(t):
    """Order totals times 1e9 and 1e-9, a third of them negative: each alone, and both mixed."""
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(f).alias("f")) for s, f in (("big", 1e9), ("small", 1e-9))]))
    sign = F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    w = t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", sign.alias("sign"), "o_totalprice", kinds.alias("s"))
    w = w.withColumns({"v": F.col("sign") * F.col("o_totalprice") * F.col("s.f")})
    both = F.explode(F.array(F.struct(F.lit("mixed").alias("g"), F.lit(1.0).alias("u")), F.struct(F.col("s.scale").alias("g"), F.col("s.f").alias("u"))))
    return w.select("o_orderkey", "o_custkey", "o_orderstatus", "v", both.alias("e")).select("o_orderkey", "o_custkey", "o_orderstatus", "v", "e.*")


def _nr(q: float) -> str:
    return f"list_sort(list(v))[round_even({q} * (count(*) - 1), 0)::BIGINT + 1]"


@query("e13_wide_values", f"""WITH {_SCALED} SELECT g, count(*) AS n, round(median(v) / max(u), 3) AS med, round({_nr(0.25)} / max(u), 3) AS p25, round({_nr(0.9)} / max(u), 3) AS p90
  FROM m WHERE g <> 'mixed' GROUP BY g UNION ALL SELECT g, count(*), round(median(v) * 1e6, 3), round({_nr(0.25)}, 0), round({_nr(0.9)}, 0) FROM m WHERE g = 'mixed' GROUP BY g""")
def e13_wide_values(t):
    """Exact quantiles at any spread of values."""
    q = R.quantiles(scaled(t).withColumn("v", F.col("v")), ["g", "u"], "v", {"med": "median", "p25": 0.25, "p90": 0.9})
    mixed = F.col("g") == "mixed"
    return q.select("g", "n", F.round(F.when(mixed, F.col("med") * 1e6).otherwise(F.col("med") / F.col("u")), 3).alias("med"),
                    *[F.when(mixed, F.round(c, 0)).otherwise(F.round(F.col(c) / F.col("u"), 3)).alias(c) for c in ("p25", "p90")])


@query("e26_auc_wide_values", f"""WITH {_SCALED}, r AS (SELECT g, (o_orderstatus = 'F') AS y, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS rk FROM m)
  SELECT g, count(*) FILTER (y)::BIGINT AS n_pos, count(*) FILTER (NOT y)::BIGINT AS n_neg,
   round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auc FROM r GROUP BY 1""")
def e26_auc_wide_values(t):
    return rounded(R.auc(scaled(t).withColumn("y", F.col("o_orderstatus") == "F"), ["g"], "y", "v"))


_avg_rank = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"


@query("e35_spearman_orders", f"""WITH r AS (SELECT o_orderpriority, {_avg_rank.format('o_orderpriority', 'o_custkey')} AS rx, {_avg_rank.format('o_orderpriority', 'o_totalprice')} AS ry FROM orders)
  SELECT o_orderpriority, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def e35_spearman_orders(t):
    """Rank correlation over all orders, with many ties on one side."""
    return rounded(R.spearman(t.read("orders"), "o_custkey", "o_totalprice", ["o_orderpriority"]))
