"""Ordered spending under a cap, a ledger over many tasks.

A call is accepted when spent + cost stays within the cap; refused calls don't spend, so order decides and a running sum is
wrong behind the first refusal. A ledger is cut into ranges of consecutive calls, and each range summed up by the sizes of
its costs (powers of two): least, largest, total. With r left in front of a range,

- what costs more than r is refused, for no more than r is ever left again;
- if all that costs at most r fits into r together, all of it is accepted.

The summaries are composed along the ledger by these two rules. Only a range for which they don't settle it, one that
straddles the cap, is opened: its calls are walked one by one. Between two ranges opened for the same reason what is left
halves, so they are few, whatever the ledger's length; each pass opens the next AHEAD of them at once. When the amount left in
front of every range is known, all ranges are decided side by side.

Costs are whole numbers of 1e-8. A null cost counts as 0. Refunds (costs below zero) are accepted; a range that holds one is
opened, and in a ledger that has any no range is passed over for what was left earlier, since that may grow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cuts import cut
from ledgerloom.functions.prefix import below

RANGE, AHEAD = 4096, 64
UNIT = 10 ** 8


def walked(left: int, costs: np.ndarray) -> tuple[np.ndarray, int]:
    """Which calls are accepted in order, and what is left."""
    taken = np.zeros(len(costs), bool)
    for i, cost in enumerate(costs.tolist()):
        if cost <= left:
            taken[i], left = True, left - cost
    return taken, left


def settled(left: int, classes: list[dict]) -> int | None:
    """What is left behind a range by its summary alone; None where it must be opened."""
    total = 0
    for c in classes:
        if c["least"] < 0 or c["least"] <= left < c["largest"]:
            return None
        if c["largest"] <= left:
            total += c["total"]
    return left - total if total <= left else None


def composed(batches: Iterable[pa.RecordBatch], cap: int, ahead: int) -> Iterator[pa.RecordBatch]:
    """Rows (ledger, range, left, open) of the ranges reached, from summaries in order: left in front of the range, null behind
    a range that has to be opened first; open marks the ranges to open next."""
    ledger: object = ()
    left: int | None = cap
    wanted = most = 0
    for batch in batches:
        out = []
        for name, at, classes, known, refunds in zip(*(batch.column(c).to_pylist() for c in ("ledger_id", "range", "classes", "known", "refunds"))):
            if name != ledger:
                ledger, left, wanted = name, cap, 0
            if left is None:
                # not reached yet; opened along with the first, unless surely nothing of it is accepted
                more = wanted < ahead and (refunds or any(c["least"] <= most for c in classes))
                wanted += more
                out.append((name, at, None, more))
                continue
            out.append((name, at, left, False))
            behind = known if known is not None else settled(left, classes)
            if behind is None:
                out[-1] = (name, at, left, True)
                most, wanted, left = left, 1, None
            else:
                left = behind
        if out:
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(cols[0], batch.schema.field("ledger_id").type), pa.array(cols[1], pa.int64()),
                                   pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())], ["ledger_id", "range", "left", "open"])


def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left behind each opened range, from calls in order (ledger, range, at, units, left of the first range).

    Ranges between opened ones that weren't sent accept nothing, so what is left carries over.
    """
    ledger, at, left, out, kind = (), None, 0, [], None
    for batch in batches:
        kind = batch.schema.field("ledger_id").type
        for name, range_, units, start in zip(*(batch.column(c).to_pylist() for c in ("ledger_id", "range", "units", "left"))):
            if (name, range_) != (ledger, at):
                if at is not None:
                    out.append((ledger, at, left))
                if name != ledger or start is not None:
                    left = start
                ledger, at = name, range_
            if units <= left:
                left -= units
    if at is not None:
        out.append((ledger, at, left))
    if out:
        cols = list(zip(*out))
        yield pa.record_batch([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["ledger_id", "range", "known"])


def decided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls in order within their ranges, with `taken` and `spent_units` so far, from what was left in front of each range."""
    key: tuple = ()
    left = cap = 0
    for batch in batches:
        ledgers, ranges = batch.column("ledger_id").to_pylist(), batch.column("range").to_pylist()
        starts, caps = batch.column("left").to_pylist(), batch.column("cap").to_pylist()
        units = batch.column("units").to_numpy()
        taken, rest = np.zeros(len(units), bool), np.zeros(len(units), np.int64)
        turns = [0, *[i for i in range(1, len(units)) if (ledgers[i], ranges[i]) != (ledgers[i - 1], ranges[i - 1])], len(units)]
        for a, z in zip(turns, turns[1:]):
            if a == z:
                continue
            if (ledgers[a], ranges[a]) != key:  # else the range goes on from the batch before
                key, left, cap = (ledgers[a], ranges[a]), starts[a], caps[a]
            part = units[a:z]
            fits = part <= left
            if (part >= 0).all() and int(part[fits].sum()) <= left:
                taken[a:z] = fits
            else:
                taken[a:z], _ = walked(left, part)
            rest[a:z] = left - np.cumsum(np.where(taken[a:z], part, 0))
            left = int(rest[z - 1])
            rest[a:z] = cap - rest[a:z]
        yield pa.record_batch([*[batch.column(c) for c in ("ledger_id", "seq", "units")], pa.array(taken), pa.array(rest)],
                              ["ledger_id", "seq", "units", "taken", "spent_units"])


def budget_guard(calls: DataFrame, cap: str, size: int = RANGE, ahead: int = AHEAD) -> DataFrame:
    """ledger_id, seq, cost, accepted, spent: decisions of every ledger in the order of seq (equal seq: lower cost first).

    calls  ledger_id (null: a ledger of its own), seq, cost decimal
    """
    limit = int(Decimal(cap) * UNIT)
    name = calls.schema["ledger_id"].dataType.simpleString()
    units = (F.coalesce(F.col("cost").cast("decimal(18,8)"), F.lit(0)) * UNIT).cast("bigint")
    rows = calls.select("ledger_id", F.col("seq").cast("bigint").alias("seq"), units.alias("units"), F.lit(1).cast("bigint").alias("_one"))
    placed = below(rows, ["ledger_id"], F.coalesce("seq", F.lit(-(1 << 63))), ["_one"], ["seq", "units"])
    placed = cut(placed.select("ledger_id", "seq", "units", F.col("_one_below").alias("at"), F.expr(f"_one_below div {int(size)}").alias("range")), "calls")

    size_class = F.when(F.col("units") < 0, -1).otherwise(F.length(F.bin("units")))
    each = placed.groupBy("ledger_id", "range", size_class.alias("class")).agg(
        F.min("units").alias("least"), F.max("units").alias("largest"), F.sum("units").alias("total"))
    # at most 64 classes a range
    summary = each.groupBy("ledger_id", "range").agg(F.collect_list(F.struct("least", "largest", "total")).alias("classes"))
    refunds = placed.where("units < 0").select(F.coalesce(F.col("ledger_id").cast("string"), F.lit("")).alias("_l"),
                                               F.col("ledger_id").isNull().alias("_n")).distinct().withColumn("refunds", F.lit(True))
    summary = summary.withColumns({"_l": F.coalesce(F.col("ledger_id").cast("string"), F.lit("")), "_n": F.col("ledger_id").isNull()})
    summary = cut(summary.join(refunds, ["_l", "_n"], "left").select("ledger_id", "range", "classes", F.coalesce("refunds", F.lit(False)).alias("refunds")), "summary")

    spark = calls.sparkSession
    known = spark.createDataFrame([], f"ledger_id {name}, range long, known long")
    while True:
        s, k = summary.alias("s"), known.alias("k")
        asked = s.join(k, F.expr("s.ledger_id <=> k.ledger_id AND s.range = k.range"), "left").select("s.*", "k.known")
        reached = cut(asked.repartition("ledger_id").sortWithinPartitions("ledger_id", "range").mapInArrow(
            lambda batches: composed(batches, limit, ahead), f"ledger_id {name}, range long, left long, open boolean"), "reached")
        wanted = reached.where("open")
        if wanted.isEmpty():
            break
        p, w = placed.alias("p"), wanted.alias("w")
        sent = p.join(w, F.expr("p.ledger_id <=> w.ledger_id AND p.range = w.range")).select("p.ledger_id", "p.range", "p.at", "p.units", "w.left")
        found = sent.repartition("ledger_id").sortWithinPartitions("ledger_id", "at").mapInArrow(opened, f"ledger_id {name}, range long, known long")
        known = cut(known.unionByName(found), "known")

    p, r = placed.alias("p"), reached.alias("r")
    fronted = p.join(r, F.expr("p.ledger_id <=> r.ledger_id AND p.range = r.range")).select("p.*", "r.left", F.lit(limit).cast("bigint").alias("cap"))
    done = fronted.repartition("ledger_id", "range").sortWithinPartitions("ledger_id", "range", "at").mapInArrow(
        decided, f"ledger_id {name}, seq long, units long, taken boolean, spent_units long")
    money = lambda c: (F.col(c).cast("decimal(27,0)") / F.lit(UNIT).cast("decimal(27,0)")).cast("decimal(18,8)")
    return done.select("ledger_id", "seq", money("units").alias("cost"), F.col("taken").alias("accepted"), money("spent_units").alias("spent"))
