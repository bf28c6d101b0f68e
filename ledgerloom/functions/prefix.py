"""Running totals in any order at any size: a tree of totals over the bits of a sortable 64-bit key.

The top 20 bits of a key name a branch, the next 22 a twig, and a twig holds its rows. Totals go up the tree by map-side
combined sums, running totals come down again by joins. No window sees more than 2^22 twigs of a branch, 2^20 branches of a
group, or the rows of one twig, whatever the values' spread and number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.groups import join_groups

BRANCH, TWIG = 44, 22


def sortable(value) -> Column:
    """A bigint in the order of a number's double value (its bits, those of negatives turned); null for null.

    Numbers beyond 2^53 may share a key, never change order.
    """
    v = F.col(value) if isinstance(value, str) else value
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v.cast("double") + F.lit(0.0)).cast("bigint")
    key = bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
    return F.when(v.isNotNull(), key)


def below(df: DataFrame, by: Sequence[str], key: Column, counts: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add <count>_below, the total over rows in front within the group, and <count>_all, the group's total.

    key    bigint that doesn't fall along `order`; rows of one key are ordered by `order`, which should tell them apart
    order  columns, or column expressions, that order the rows of a twig
    """
    by = list(by)
    keyed = df.withColumn("_key", key).withColumns({"_k1": F.shiftright("_key", BRANCH), "_k2": F.shiftright("_key", TWIG)}).drop("_key")
    twigs = keyed.groupBy(*by, "_k1", "_k2").agg(*[F.sum(c).alias(c) for c in counts])
    branches = twigs.groupBy(*by, "_k1").agg(*[F.sum(c).alias(c) for c in counts])
    group = by or [F.lit(0)]

    def before(part, *along):
        return Window.partitionBy(*part).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)

    def total(c, window):
        return F.coalesce(F.sum(c).over(window), F.lit(0))

    whole = Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    branches = branches.select(*by, "_k1", *[total(c, before(group, "_k1")).alias(f"_{c}1") for c in counts],
                               *[F.sum(c).over(whole).alias(f"{c}_all") for c in counts])
    twigs = join_groups(twigs, branches, [*by, "_k1"]).select(
        *by, "_k2", *[(F.col(f"_{c}1") + total(c, before([*by, "_k1"], "_k2"))).alias(f"_{c}0") for c in counts], *[f"{c}_all" for c in counts])
    leaf = before([*by, "_k2"], *order)
    joined = join_groups(keyed.drop("_k1"), twigs, [*by, "_k2"])
    return joined.select(*df.columns, *[(F.col(f"_{c}0") + total(c, leaf)).alias(f"{c}_below") for c in counts], *[f"{c}_all" for c in counts])
