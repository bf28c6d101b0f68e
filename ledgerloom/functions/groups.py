"""Joins of tables that share their group columns, in which a null group is a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """`left.join(right, by, how)` for inner and left joins, with null equal to null."""
    other = right.withColumnsRenamed({b: f"_g_{b}" for b in by})
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by], F.lit(True))
    return left.join(other, same, how).drop(*[f"_g_{b}" for b in by])
