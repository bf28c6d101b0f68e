"""Deterministic resampling that never moves units between tasks.

Two methods share one interface:

poisson      (default) each unit of each draw gets a Poisson(1) weight from a hash. Identical units
             are first counted into cells, so the cost follows the number of distinct statistics and
             not the number of rows. A cell of m units gets exactly Poisson(m) at every m: the sum of m
             unit weights, or from `REJECTION` units on one transformed rejection sample of that same
             law. One pass, no join, map-side combined.
multinomial  the classical scheme, n slots filled by hashed unit index. Its cost is rows times draws: slots counted in
             a task, whose digests the groups of a range of draws share, and rows that are joined back for groups beyond
             PACKED units.

Keyed units take Poisson weights too, each a row of its own: a task multiplies the weights of a block of units (draws
wide, from digests) with their statistics and keeps the sums, so what it passes on is draws times statistics per group and
not units times draws.

Every draw depends on (seed, draw, unit key) alone: results do not change with partitioning or retries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.functions import stats as S
from ledgerloom.functions.cuts import cut
from ledgerloom.functions.groups import join_groups
from ledgerloom.functions.text import let

#: Units from which a cell's weight comes from the rejection sampler, whose bounds hold for means of 10 and more.
REJECTION = 16
#: Tries of the sampler. One is accepted with probability 0.8 or more, so all of them fail in less than one of 10^16 draws.
TRIES = 24
#: Keyed units whose weights are held at once, and bytes of sums that a task holds before it passes them on.
UNITS, HELD = 256, 64 << 20
#: Units of a group whose statistics a task of the classical scheme holds, and slots that it hashes at once.
PACKED, SLOTS = 2_000_000, 1 << 16


def _key(cols: Sequence[str]):
    return F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in cols])


def draws_of(units: DataFrame, by: Sequence[str], stats: Sequence[str], key: Sequence[str] | None = None,
             draws: int = 2000, seed: int = 0, spread: bool = True, whole: bool = False) -> DataFrame:
    """Weighted sums per draw: columns by..., draw, n (total weight), and one sum per statistic.

    units   one row per resampled unit, numeric statistic columns
    key     unit identity columns; without it units with equal statistics are merged into cells
    spread  deal keyed units out to all tasks first; not needed where they come from a scan of many splits
    whole   keyed units only: leave out units with a null statistic, and add the plain sums as draw -1, from the same pass
    """
    by, stats = list(by), list(stats)
    if key is None:
        return draws_of_cells(units.groupBy(*by, *stats).agg(F.count("*").alias("_m")), by, stats, draws, seed)
    keyed = units.select(*by, *[F.col(x).cast("double").alias(x) for x in stats], _key(by + list(key)).alias("_id"))
    if spread:
        keyed = keyed.repartition(max(1, keyed.sparkSession.sparkContext.defaultParallelism), "_id")
    return _keyed(keyed, by, stats, draws, seed, whole)


def unit_weights(ids: Sequence[str], draws: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, units by draws: four to a digest of (seed, block of draws, 1, unit)."""
    md5 = hashlib.md5
    heads = [f"{seed}|{block}|1|".encode() for block in range(draws // 4)]
    raw = b"".join([md5(h + i).digest() for i in [x.encode() for x in ids] for h in heads])
    u = np.frombuffer(raw, ">u4").reshape(len(ids), draws) / 4294967296.0
    return np.searchsorted(np.array(S.POISSON_CDF), u, side="right").astype(np.float64)


def _keyed(units: DataFrame, by: list[str], stats: list[str], draws: int, seed: int, whole: bool) -> DataFrame:
    """Sums per group and draw of units (by, stats as doubles, _id), reduced in the tasks first."""
    if draws % 4:
        raise ValueError("draws come four to a digest; use a multiple of four")
    double = T.DoubleType()
    schema = T.StructType([*[units.schema[b] for b in by], T.StructField("draw", T.IntegerType()),
                           *[T.StructField(c, double) for c in ("n", *stats)]])
    arrow = to_arrow_schema(schema)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flushed():
            for group, sums in held.items():
                yield pa.record_batch([*[pa.array([g] * len(sums), f.type) for g, f in zip(group, arrow)], pa.array(range(draws - len(sums), draws), pa.int32()),
                                       *[pa.array(col) for col in sums.T]], schema=arrow)
            held.clear()
        for batch in batches:
            groups = list(zip(*[batch.column(b).to_pylist() for b in by])) if by else [()] * batch.num_rows
            ids = batch.column("_id").to_pylist()
            values = np.column_stack([np.ones(len(ids)), *[pc.fill_null(batch.column(x), 0.0).to_numpy(zero_copy_only=False) for x in stats]])
            if whole:
                values[np.logical_or.reduce([pc.is_null(batch.column(x)).to_numpy(zero_copy_only=False) for x in stats])] = 0.0
            for at in range(0, len(ids), UNITS):
                weights = unit_weights(ids[at:at + UNITS], draws, seed)
                if whole:
                    weights = np.column_stack([np.ones(len(weights)), weights])
                rows: dict[tuple, list[int]] = {}
                for k, group in enumerate(groups[at:at + UNITS]):
                    rows.setdefault(group, []).append(k)
                for group, which in rows.items():
                    sums = weights[which].T @ values[at:at + UNITS][which]
                    held[group] = held[group] + sums if group in held else sums
                if len(held) * draws * values.shape[1] * 8 > HELD:
                    yield from flushed()
        yield from flushed()

    return units.mapInArrow(summed, schema).groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in ("n", *stats)])


def draws_of_cells(cells: DataFrame, by: Sequence[str], stats: Sequence[str], draws: int = 2000,
                   seed: int = 0, ident: Sequence[str] | None = None) -> DataFrame:
    """`draws_of` for units already counted into cells (column _m = units with these statistics).

    ident  columns that identify a cell, where not all of by and stats are needed
    """
    return _draw(cells, list(by), list(stats), _key(list(ident or [*by, *stats])), draws, seed)


def _draw(cells, by, stats, ident, draws, seed):
    if draws % 4:
        raise ValueError("draws come four to a digest; use a multiple of four")
    cells = cells.select(*by, *stats, "_m", ident.alias("_id"))

    # Cells are few, small rows; the work is in the draws, so they spread by draw block and no task holds all of it;
    # the sums combine map-side before the second exchange.
    tasks = max(1, cells.sparkSession.sparkContext.defaultParallelism)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(draws // 4 - 1)))
    few = cells.where(F.col("_m") < REJECTION).withColumn("_blk", blocks).repartition(min(tasks, draws // 4), "_blk")
    small = (
        few.withColumn("_slot", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))))
        .withColumn("_d", F.md5(F.concat_ws("|", F.lit(seed), F.col("_blk"), F.col("_slot"), F.col("_id"))))
    )
    quad = F.explode(F.array(*[
        F.struct((F.col("_blk") * 4 + q).alias("draw"), S.hex_uniform("_d", 1 + 8 * q).alias("u")) for q in range(4)]))
    small = small.select(*by, *stats, quad.alias("_e")).select(
        *by, *stats, F.col("_e.draw").alias("draw"), S.poisson_one("_e.u").cast("double").alias("_w"))
    small = small.groupBy(*by, "draw").agg(
        F.sum("_w").alias("n"), *[F.sum(F.col("_w") * F.col(s)).alias(s) for s in stats])

    large = cells.where(F.col("_m") >= REJECTION).withColumn("_blk", blocks)
    large = large.repartition(min(tasks, draws // 4), "_blk").withColumn(
        "draw", F.explode(F.array(*[F.col("_blk") * 4 + q for q in range(4)])))
    w = poisson_many("_m", lambda i: F.md5(F.concat_ws("|", F.lit(seed), F.lit("z"), F.col("draw"), i, F.col("_id"))))
    large = large.select(*by, "draw", w.alias("_w"), *stats)
    large = large.groupBy(*by, "draw").agg(
        F.sum("_w").alias("n"), *[F.sum(F.col("_w") * F.col(s)).alias(s) for s in stats])
    return small.unionByName(large).groupBy(*by, "draw").agg(
        F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in stats])


def poisson_many(m, digest):
    """An exact Poisson(m) count for m of 10 and more by Hoermann's transformed rejection.

    digest  function of the try's number, giving 16 hex digits or more
    """
    m = S.c(m).cast("double")
    b = F.lit(0.931) + F.lit(2.53) * F.sqrt(m)
    par = F.struct(m.alias("m"), b.alias("b"), (F.lit(-0.059) + F.lit(0.02483) * b).alias("a"),
                   F.log(F.lit(1.1239) + F.lit(1.1328) / (b - 3.4)).alias("q"), (F.lit(0.9277) - F.lit(3.6224) / (b - 2)).alias("r"))

    def log_mass(k, p):
        tail = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * F.pow(k, F.lit(5)))
        near = -k * F.log1p((k - p["m"]) / p["m"]) + (k - p["m"]) - F.log(F.lit(6.283185307179586) * k) / 2 - tail
        return F.when(k >= 16, near).otherwise(k * F.log(p["m"]) - p["m"] - F.log(F.factorial(k.cast("int"))))

    def judged(e, p):
        near = F.log(e["v"]) + p["q"] - F.log(p["a"] / (e["s"] * e["s"]) + p["b"]) <= log_mass(e["k"], p)
        sure = (e["s"] >= 0.07) & (e["v"] <= p["r"])
        outside = (e["k"] < 0) | ((e["s"] < 0.013) & (e["v"] > e["s"]))
        return F.when(sure, e["k"]).when(outside, F.lit(None).cast("double")).when(near, e["k"])

    def tried(d, p):
        u = let(S.hex_uniform(d, 1) - 0.5, lambda x: F.struct(
            x.alias("u"), F.greatest(0.5 - F.abs(x), F.lit(2.0 ** -33)).alias("s"), (1 - S.hex_uniform(d, 9)).alias("v")))
        e = let(u, lambda t: F.struct(
            F.floor((2 * p["a"] / t["s"] + p["b"]) * t["u"] + p["m"] + 0.43).cast("double").alias("k"), t["s"].alias("s"), t["v"].alias("v")))
        return let(e, lambda x: judged(x, p))

    first = let(par, lambda p: F.aggregate(
        F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"),
        lambda got, i: F.when(got.isNotNull(), got).otherwise(let(digest(i), lambda d: tried(d, p)))))
    return F.coalesce(first, m)


def multinomial_draws(units: DataFrame, by: Sequence[str], stats: Sequence[str], key: Sequence[str],
                      draws: int = 2000, seed: int = 0) -> DataFrame:
    """Classical resampling with replacement: `draws_of`'s columns, every draw of a group's own size.

    Slots are hashed to unit ranks; weights are the slot counts. The statistics of a group of at most PACKED units, a few
    numbers each, are sent to every range of draws, which hashes its slots in place; of larger groups (group, draw, rank)
    counts are joined back to the units. Units rank by the digest of their key in two levels, its first digits and the
    rest, so that no task ranks a whole group. The units' statistics are written first: the runs are read once.
    """
    by, stats = list(by), list(stats)
    marked = units.select(*by, *stats, *[k for k in key if k not in by and k not in stats], F.md5(_key(key)).alias("_h"))
    marked = cut(marked.withColumn("_top", F.substring("_h", 1, 3)), "units")
    tops = marked.groupBy(*by, "_top").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    before = F.sum("_c").over(group.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*by, "_top", F.coalesce(before, F.lit(0)).alias("_b"), F.sum("_c").over(group).alias("_n"))
    inner = Window.partitionBy(*by, "_top").orderBy("_h", *key)
    ranked = join_groups(marked.withColumn("_i", F.row_number().over(inner)), tops, [*by, "_top"]).select(
        *by, *stats, "_n", (F.col("_b") + F.col("_i") - 1).alias("_pick"))
    plain = all(isinstance(units.schema[x].dataType, (T.IntegralType, T.FractionalType)) and not isinstance(units.schema[x].dataType, T.DecimalType) for x in stats)
    if not plain:
        return _shuffled_slots(ranked, by, stats, draws, seed)
    small = _packed_slots(ranked.where(F.col("_n") <= PACKED), by, stats, draws, seed)
    if not tops.where(F.col("_n") > PACKED).head(1):
        return small
    return small.unionByName(_shuffled_slots(ranked.where(F.col("_n") > PACKED), by, stats, draws, seed))


def _packed_slots(ranked: DataFrame, by: list[str], stats: list[str], draws: int, seed: int) -> DataFrame:
    """Slots of groups whose statistics fit a task: these go to every range of draws, no slot leaves its task."""
    whole = {x: isinstance(ranked.schema[x].dataType, T.IntegralType) for x in stats}
    fields = [*[T.StructField(f"_g{i}", ranked.schema[b].dataType) for i, b in enumerate(by)], T.StructField("draw", T.IntegerType()),
              T.StructField("n", T.DoubleType()), *[T.StructField(x, T.DoubleType()) for x in stats]]
    arrow = to_arrow_schema(T.StructType(fields))
    tasks = max(1, min(draws, 4 * ranked.sparkSession.sparkContext.defaultParallelism))
    width = -(-draws // tasks)
    ranges = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(width)))
    packed = ranked.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], *[F.col(x).cast("double").alias(x) for x in stats], "_pick", ranges.alias("_from"))
    held = [f"_g{i}" for i in range(len(by))]

    def drawn(table: pa.Table) -> pa.Table:
        n, first = table.num_rows, table.column("_from")[0].as_py()
        order = np.argsort(table.column("_pick").to_numpy())
        values, known = [], []
        for x in stats:
            known.append(pc.is_valid(table.column(x)).to_numpy()[order])
            values.append(pc.fill_null(table.column(x), 0.0).to_numpy()[order])
        at = range(first, min(first + width, draws))
        for key in [k for k in _known if k[0] != seed or k[1] not in at]:
            del _known[key]
        sums: list[list[float | None]] = [[] for _ in stats]
        for draw in at:
            weights = slot_counts(n, draw, seed)
            there = weights > 0
            for out, v, k in zip(sums, values, known):
                used = there & k
                out.append(float(weights[used] @ v[used]) if used.any() else None)
        groups = [pa.array([table.column(g)[0].as_py()] * len(at), arrow.field(g).type) for g in held]
        return pa.table([*groups, pa.array(at, pa.int32()), pa.array([float(n)] * len(at)), *[pa.array(s, pa.float64()) for s in sums]], schema=arrow)

    # a range's groups follow each other in one task, which hashes its slots once
    out = packed.repartition(tasks, "_from").groupBy("_from", *held).applyInArrow(drawn, T.StructType(fields))
    return out.select(*[F.col(g).alias(b) for g, b in zip(held, by)], "draw", "n", *[
        F.col(x).cast("bigint").alias(x) if whole[x] else F.col(x) for x in stats])


def slot_counts(n: int, draw: int, seed: int) -> np.ndarray:
    """How often a draw's n slots pick each of n units: 60 bits of the digest of (seed, draw, slot), modulo n."""
    counts = np.zeros(n, np.int64)
    for at in range(0, n, SLOTS):
        counts += np.bincount(slot_values(draw, seed, at, min(SLOTS, n - at)) % n, minlength=n)
    return counts.astype(np.float64)


#: Slots of the range of draws that a worker is at, by (seed, draw, first slot): every group of the range reads the same ones.
_known: dict[tuple[int, int, int], np.ndarray] = {}


def slot_values(draw: int, seed: int, at: int, n: int) -> np.ndarray:
    """60 bits of the digests of n of a draw's slots from `at` on; kept for other groups while all take less than HELD bytes."""
    found = _known.get((seed, draw, at), np.zeros(0, np.int64))
    if len(found) < n:
        to = at + max(n, min(SLOTS, 2 * len(found)))
        found = np.concatenate([found, (digests(f"{seed}|{draw}|", at + len(found), to) >> np.uint64(4)).astype(np.int64)])
        if sum(v.nbytes for v in _known.values()) + found.nbytes <= HELD:
            _known[seed, draw, at] = found
    return found[:n]


def digests(head: str, start: int, stop: int) -> np.ndarray:
    """First 8 bytes (big-endian) of the md5 of head followed by each number from start to stop."""
    out, at = [], start
    while at < stop:
        digits = len(str(at))
        to = min(stop, 10 ** digits, at + LANES)
        out.append(_md5_heads(head.encode(), np.arange(at, to, dtype=np.int64), digits))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


#: Numbers that are hashed side by side, and the constants of md5: shifts and sines.
LANES = 1 << 13
_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_SINES = np.array([int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)], np.uint32)


def _md5_heads(head: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """`digests` of numbers of so many digits: one block of md5 for all of them at once."""
    size = len(head) + digits
    if size > 55:
        return np.frombuffer(b"".join([hashlib.md5(head + b"%d" % j).digest()[:8] for j in numbers.tolist()]), ">u8").astype(np.uint64)
    block = bytearray(head.ljust(64, b"\0"))
    block[size], block[56:58] = 128, (8 * size).to_bytes(2, "little")
    words, left = list(np.frombuffer(bytes(block), "<u4").astype(np.uint32)), numbers
    for place in range(size - 1, len(head) - 1, -1):
        left, digit = np.divmod(left, 10)
        words[place // 4] = words[place // 4] | (digit + 48).astype(np.uint32) << np.uint32(8 * (place % 4))
    start = [np.uint32(x) for x in (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)]
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in start)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            word = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            word = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            word = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            word = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[word], out=f)
        np.add(f, _SINES[i], out=f)
        np.right_shift(f, np.uint32(32) - _SHIFTS[i], out=g)
        np.left_shift(f, _SHIFTS[i], out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    first, second = (a + start[0]).astype("<u4"), (b + start[1]).astype("<u4")
    return first.byteswap().astype(np.uint64) << np.uint64(32) | second.byteswap().astype(np.uint64)


def _shuffled_slots(ranked: DataFrame, by: list[str], stats: list[str], draws: int, seed: int) -> DataFrame:
    """Slots of groups of any size, as rows that meet their units by a join."""
    slots = ranked.select(*by, "_n", "_pick", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw"), F.col("_pick")))
    at = F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("bigint") % F.col("_n")
    picked = slots.select(*by, "draw", at.alias("_pick")).groupBy(*by, "draw", "_pick").agg(F.count("*").alias("_w"))
    return join_groups(picked, ranked.drop("_n"), [*by, "_pick"]).groupBy(*by, "draw").agg(
        F.sum("_w").cast("double").alias("n"), *[F.sum(F.col("_w") * F.col(s)).alias(s) for s in stats])


def intervals(drawn: DataFrame, by: Sequence[str], rule: str = "floor_ceil", draws: int = 2000,
              alpha: float = 0.05, needs: dict[str, float] | None = None, **values) -> DataFrame:
    """One row per group with <name>_lo and <name>_hi for every named expression over a draw.

    Null draws are unusable; with fewer than half usable the interval is null. The sorted array per
    group holds at most `draws` numbers.
    """
    by = list(by)
    cut = drawn.select(*by, *[e.alias(name) for name, e in values.items()])
    packed = cut.groupBy(*by).agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in values])
    out = []
    for n in values:
        lo, hi = S.interval(n, rule, alpha)
        enough = F.size(n) >= (needs or {}).get(n, draws * 0.5)
        out += [F.when(enough, lo).alias(f"{n}_lo"), F.when(enough, hi).alias(f"{n}_hi")]
    return packed.select(*by, *out)
