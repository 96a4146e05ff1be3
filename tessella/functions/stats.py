"""Exact tests and estimators as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ln_choose(n: Column, k: Column) -> Column:
    """ln C(n, k) as a sum over 1..k."""
    n, k = n.cast("long"), k.cast("long")
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c discordant pairs; 1 without any."""
    n, m = (b + c).cast("long"), F.least(b, c).cast("long")
    # Each term from the one before, in logarithms: ln C(n, i + 1) = ln C(n, i) + ln((n - i) / (i + 1)).
    start = F.struct(F.lit(0.0).alias("ln"), F.exp(-n * F.log(F.lit(2.0))).alias("p"))
    steps = F.when(m >= 1, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))

    def step(a, i):
        ln = a["ln"] + F.log((n - i + 1) / i)
        return F.struct(ln.alias("ln"), (a["p"] + F.exp(ln - n * F.log(F.lit(2.0)))).alias("p"))

    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step)["p"]))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2 x 2 table: tables at most as likely as this one; 1 if a margin is zero.

    Weights go from the likeliest table outwards, each from the one before, in logarithms. By Hoeffding's bound all tables further
    away than 20 times the root of the least margin have less than e^-800 together, which is zero in doubles, so the steps go by that root.
    """
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    r1, r2, c1, c2 = a + b, c + d, a + c, b + d
    lo, hi = F.greatest(F.lit(0).cast("long"), c1 - r2), F.least(c1, r1)
    mode = F.least(hi, F.greatest(lo, F.floor((r1 + 1).cast("double") * (c1 + 1) / (r1 + r2 + 2)).cast("long")))
    reach = F.ceil(20 * F.sqrt(F.least(r1, r2, c1, c2))).cast("long") + 2
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    # The logarithm of the weight of x + 1 over that of x.
    rise = lambda x: F.log((r1 - x).cast("double") * (c1 - x) / ((x + 1).cast("double") * (r2 - c1 + x + 1)))
    own = F.aggregate(upto(F.least(F.abs(a - mode), reach)), F.lit(0.0), lambda s, i: F.when(a >= mode, s + rise(mode + i - 1)).otherwise(s - rise(mode - i)))
    own = F.when(F.abs(a - mode) > reach, 0.0).otherwise(F.exp(own))
    up, down = F.least(hi - mode, reach), F.least(mode - lo, reach)
    # What a lambda holds is computed at each step, so what it needs once goes along.
    start = F.struct(F.lit(0.0).alias("ln"), F.lit(1.0).alias("all"), F.when(own * (1 + 1e-9) >= 1, 1.0).otherwise(0.0).alias("tail"), (own * (1 + 1e-9)).alias("most"), mode.alias("mode"), up.alias("up"))

    def step(s, i):
        above = i <= s["up"]
        j = i - s["up"]
        ln = F.when(above, s["ln"] + rise(s["mode"] + i - 1)).otherwise(F.when(j == 1, 0.0).otherwise(s["ln"]) - rise(s["mode"] - j))
        w = F.exp(ln)
        return F.struct(ln.alias("ln"), (s["all"] + w).alias("all"), F.when(w <= s["most"], s["tail"] + w).otherwise(s["tail"]).alias("tail"), s["most"].alias("most"), s["mode"].alias("mode"), s["up"].alias("up"))

    p = F.aggregate(upto(up + down), start, step, lambda s: F.least(F.lit(1.0), s["tail"] / s["all"]))
    return F.when((r1 == 0) | (r2 == 0) | (c1 == 0) | (c2 == 0), 1.0).otherwise(p)


def pass_at_k(draws: Column, solved: Column, k: Column) -> Column:
    """Unbiased chance that k of ``draws`` hold a solved one: 1 - C(n - c, k) / C(n, k)."""
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), (k - 1).cast("long")), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0.0), (draws - solved - i) / (draws - i)))
    return F.when(k > draws, F.raise_error(F.lit("k is larger than the number of draws"))).otherwise(1 - miss)


def tie_probability(n: Column) -> Column:
    """Chance that n discordant pairs split evenly; null if n is odd or 0."""
    return F.when((n > 0) & (n % 2 == 0), F.exp(_ln_choose(n, (n / 2).cast("long")) - n * F.log(F.lit(2.0))))


def verdict(lo: Column, hi: Column, p: Column) -> Column:
    out, sig = (lo > 0) | (hi < 0), p < 0.05
    return F.when(out & sig, "significant").when(out | sig, "borderline").otherwise("not significant")


def draw(*parts: Column) -> Column:
    """A counter-based random number of 32 bits: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("long")
