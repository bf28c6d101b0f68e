"""Closed-form statistics as column expressions over exact sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """num / den, null where the denominator is zero."""
    return F.when(c(den) != 0, c(num).cast("double") / c(den))


def wilson(k, n, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval clipped to [0, 1]; null at n = 0."""
    n = F.when(c(n) > 0, c(n).cast("double"))
    p = c(k) / n
    d = 1 + F.lit(z * z) / n
    mid = (p + F.lit(z * z / 2) / n) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z / 4) / (n * n)) / d
    # least and greatest skip nulls, so the empty case is kept null by hand
    return (F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)),
            F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half)))


def ols_terms(n, sx, sy, sxx, sxy, syy=None) -> dict[str, Column]:
    """Slope, intercept and R2 from sums. Null slope when x is constant, null R2 when y is."""
    n, sx, sy, sxx, sxy = (c(v).cast("double") for v in (n, sx, sy, sxx, sxy))
    vx, cov = n * sxx - sx * sx, n * sxy - sx * sy
    slope = F.when(vx > 1e-9, cov / vx)
    out = {"slope": slope, "intercept": (sy - slope * sx) / n}
    if syy is not None:
        vy = n * c(syy).cast("double") - sy * sy
        out["r2"] = F.when((vx > 1e-9) & (vy > 1e-9), cov * cov / (vx * vy))
    return out


def quadratic_term(n, sx, sxx, sx3, sx4, sy, sxy, sxxy) -> Column:
    """Coefficient a of y = c + b x + a x^2 by Cramer's rule; null when the design is singular."""
    s0, s1, s2, s3, s4, t0, t1, t2 = (c(v).cast("double") for v in (n, sx, sxx, sx3, sx4, sy, sxy, sxxy))

    def det(p, q, r):
        (a, b, d), (e, f, g), (h, i, j) = p, q, r
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    base = det((s0, s1, s2), (s1, s2, s3), (s2, s3, s4))
    return F.when(F.abs(base) > 1e-6, det((s0, s1, t0), (s1, s2, t1), (s2, s3, t2)) / base)


# Poisson(1) cumulative probabilities, from the definition.
POISSON_CDF: list[float] = []
_term, _total = 2.718281828459045 ** -1, 0.0
for _k in range(13):
    _total += _term
    POISSON_CDF.append(_total)
    _term /= _k + 1


def poisson_one(u) -> Column:
    """Poisson(1) count of a uniform by inversion; the rare tail is counted off the table.

    Kept short on purpose: a branch per count, four times over, outgrows what the JIT compiles.
    """
    tail = F.size(F.filter(F.array(*[F.lit(p) for p in POISSON_CDF]), lambda p: p <= c(u)))
    return reduce(lambda acc, kp: F.when(c(u) < kp[1], F.lit(kp[0])).otherwise(acc),
                  reversed(list(enumerate(POISSON_CDF[:4]))), tail)


def hex_uniform(digest, offset: int) -> Column:
    """Uniform in [0, 1) from eight hex digits of a digest, starting at a 1-based offset."""
    return F.conv(F.substr(c(digest), F.lit(offset), F.lit(8)), 16, 10).cast("bigint") / F.lit(4294967296.0)


def interval(values, rule: str = "floor_ceil", alpha: float = 0.05, draws=None) -> tuple[Column, Column]:
    """Percentile interval of a sorted array (1-based element_at) under one of the index rules.

    floor_ceil  floor(a/2 * n) and ceil((1 - a/2) * n) - 1
    truncate    int(a/2 * n) and int((1 - a/2) * n), the last capped
    fixed       a/2 * n and (1 - a/2) * n - 1 (50 and 1949 of 2,000; 125 and 4874 of 5,000)
    """
    n = F.size(c(values))
    per = round(alpha / 2 * 1000)
    low = F.floor(n * F.lit(per) / F.lit(1000)).cast("int")
    if rule == "floor_ceil":
        high = F.ceil(n * F.lit(1000 - per) / F.lit(1000)).cast("int") - 1
    elif rule == "truncate":
        high = F.least(n - 1, F.floor(n * F.lit(1000 - per) / F.lit(1000)).cast("int"))
    elif rule == "fixed":
        high = F.floor(n * F.lit(1000 - per) / F.lit(1000)).cast("int") - 1
    else:
        raise ValueError(rule)
    return (F.get(c(values), F.greatest(low, F.lit(0))), F.get(c(values), F.greatest(high, F.lit(0))))


def nearest_rank_sorted(values, q: float) -> Column:
    """Nearest-rank quantile of a sorted array, banker's rounding of q (n - 1)."""
    return F.get(c(values), F.bround(F.lit(q) * (F.size(c(values)) - 1), 0).cast("int"))
