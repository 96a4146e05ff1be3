"""Any number of paired comparisons at once: each arm's outcomes are joined with the contrasts it is part of, and one shuffle brings the pairs together.

Differences of paired outcomes are -1, 0 or 1, so their bootstrap depends on three counts alone: the sum of a resample is that of
independent draws with the shares of the counts. Its distribution is computed, not sampled, and so is that of sums under random signs; both are what
resampling tends to, and cost the same for any number of problems.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions import stats
from .reports import agrees
from .runs import GuardError

#: Fixed value: how an attempt ends that the harness, not the prover, has lost.
ERRORS = ("error",)


def distribution(n: int, plus: int, minus: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` independent draws that are 1 with a share of plus / n, -1 with minus / n and else 0, and how likely each is; sums beyond 12 standard deviations are left out."""
    mean, var = plus - minus, (plus + minus) - (plus - minus) ** 2 / n
    half = min(n + abs(mean) + 1, int(12 * var**0.5) + 8)
    size = 2 * half + 1
    # The characteristic function at as many points as there are sums; what lies beyond them wraps around and is nil.
    t = 2 * np.pi * np.arange(size) / size
    phi = (n - plus - minus) / n + plus / n * np.exp(1j * t) + minus / n * np.exp(-1j * t)
    first = round(mean) - half
    with np.errstate(divide="ignore"):
        p = np.fft.fft(np.exp(n * np.log(phi) - 1j * t * first)).real / size
    return np.arange(first, first + size), np.clip(p, 0, None)


def interval(n: int, plus: int, minus: int, alpha: float = 0.05) -> tuple[float, float]:
    """The percentile bootstrap's interval of the mean difference: the least sums whose distribution function reaches alpha / 2 and 1 - alpha / 2, by ``n``."""
    if not n:
        return float("nan"), float("nan")
    sums, p = distribution(n, plus, minus)
    at = np.round(np.cumsum(p), 10)
    return sums[np.searchsorted(at, alpha / 2)] / n, sums[min(len(at) - 1, np.searchsorted(at, round(1 - alpha / 2, 10)))] / n


@F.pandas_udf(StructType().add("lo", DoubleType()).add("hi", DoubleType()))
def _interval(n: pd.Series, plus: pd.Series, minus: pd.Series) -> pd.DataFrame:
    rows = [interval(int(a), int(b), int(c)) for a, b, c in zip(n, plus, minus, strict=True)]
    return pd.DataFrame(rows, columns=["lo", "hi"])


def paired(arms: DataFrame, contrasts: list[tuple[str, str]], errors: tuple[str, ...] = ERRORS) -> DataFrame:
    """baseline, treatment, benchmark, pid, a, b (solved by each), clean (neither ended in an error), names (of the treatment) of every problem that both sides of a contrast have tried.

    arms: benchmark, label, pid, solved, status, names (does a solved proof name a premise; null where its policy doesn't let that be told), a row for each label and problem.
    """
    for a, b in contrasts:
        if a == b:
            raise GuardError(f"both sides are {a}; there is nothing to compare")
    if len(set(contrasts)) < len(contrasts):
        raise GuardError("a contrast is named twice")
    sides = [(label, a, b, side) for a, b in contrasts for side, label in ((0, a), (1, b))]
    own = F.broadcast(arms.sparkSession.createDataFrame(sides, "label string, baseline string, treatment string, side int"))
    at = lambda side, c: F.max(F.when(F.col("side") == side, c))
    bad = F.col("status").isin(*errors)
    g = arms.join(own, "label").groupBy("baseline", "treatment", "benchmark", "pid").agg(at(0, F.col("solved")).alias("a"), at(1, F.col("solved")).alias("b"), (~F.coalesce(F.max(bad), F.lit(False))).alias("clean"), at(1, F.col("names")).alias("names"))
    return g.where("a is not null and b is not null")


def _counts(some: Column, end: str) -> list[Column]:
    a, b = F.col("a"), F.col("b")
    one = lambda c, name: F.count_if(some & c).alias(name + end)
    return [F.count_if(some).alias("n" + end), one(a, "n_baseline"), one(b, "n_treatment"), one(a & b, "n_both"), one(a & ~b, "only_baseline"), one(b & ~a, "only_treatment")]


def _judged(df: DataFrame, end: str) -> DataFrame:
    n, plus, minus = (F.col(c + end) for c in ("n", "only_treatment", "only_baseline"))
    df = df.withColumn("_i", _interval(n, plus, minus)).withColumn("lo" + end, F.round(F.nanvl("_i.lo", F.lit(None)), 6)).withColumn("hi" + end, F.round(F.nanvl("_i.hi", F.lit(None)), 6))
    p, lo, hi = stats.mcnemar(plus, minus), F.col("lo" + end), F.col("hi" + end)
    return (df.withColumn("delta" + end, F.round((plus - minus) / F.nullif(n, F.lit(0)), 6)).withColumn("p" + end, F.round(p, 6))
            .withColumn("verdict" + end, stats.verdict(lo, hi, p)).withColumn("agree" + end, agrees(lo, hi, p)).drop("_i"))


def compare_arms(arms: DataFrame, contrasts: list[tuple[str, str]], errors: tuple[str, ...] = ERRORS) -> DataFrame:
    """One row for each contrast and benchmark, and one over all benchmarks (benchmark null), with the problems of errors kept and, ending in ``_clean``, left out.

    n, n_baseline, n_treatment, n_both, only_baseline, only_treatment, union_gain (over the better side), baseline_is_subset, lo and hi (95 % of
    the bootstrap of the difference of rates), delta, p (random signs, which is the exact McNemar test), verdict, agree (do interval and test say the same);
    flips (does the verdict change without the errors); used and needed (of the treatment's proofs, and of those that it alone has, the share that names a premise; null where that can't be told);
    heterogeneous (do benchmarks point in different directions). Contrasts whose sides share no problem have no row.
    """
    pairs = paired(arms, contrasts, errors)
    every, clean = F.lit(True), F.col("clean")
    told = F.col("names").isNotNull()
    named = [F.count_if(F.col("b") & F.col("names")).alias("_used"), F.count_if(F.col("b") & ~F.col("a") & F.col("names")).alias("_needed"), F.count_if(F.col("b") & told).alias("_told")]
    # Counts of each benchmark, from which those of all are summed up: pairs are shuffled once.
    one = pairs.groupBy("baseline", "treatment", "benchmark").agg(*_counts(every, ""), *_counts(clean, "_clean"), *named)
    numbers = [c for c in one.columns if c not in ("baseline", "treatment", "benchmark")]
    sign = F.signum(F.col("only_treatment") - F.col("only_baseline"))
    whole = one.groupBy("baseline", "treatment").agg(*[F.sum(c).alias(c) for c in numbers], (F.count_distinct(F.when(sign != 0, sign)) > 1).alias("heterogeneous")).withColumn("benchmark", F.lit(None).cast(one.schema["benchmark"].dataType))
    out = _judged(_judged(one.withColumn("heterogeneous", F.lit(False)).unionByName(whole), ""), "_clean")
    share = lambda x, n: F.when(F.col("_told") > 0, F.round(F.col(x) / F.nullif(n, F.lit(0)), 6))
    return (out.withColumn("union_gain", F.least("n_baseline", "n_treatment") - F.col("n_both")).withColumn("baseline_is_subset", F.col("only_baseline") == 0)
            .withColumn("flips", (F.col("verdict") == "significant") != (F.col("verdict_clean") == "significant"))
            .withColumn("used", share("_used", F.col("n_treatment"))).withColumn("needed", share("_needed", F.col("only_treatment"))).drop("_used", "_needed", "_told"))


def format_report(row: dict) -> str:
    """One contrast as lines of text."""
    where = row["benchmark"] if row["benchmark"] is not None else "all benchmarks"
    lines = [f"{row['treatment']} against {row['baseline']} on {where}: {row['n_treatment']} and {row['n_baseline']} of {row['n']} problems, {row['only_treatment']} and {row['only_baseline']} alone"]
    for end, what in (("", "all problems"), ("_clean", "without errors")):
        lines.append(f"  {what} ({row['n' + end]}): difference {row['delta' + end]}, 95 % interval {row['lo' + end]} to {row['hi' + end]}, p {row['p' + end]}: {row['verdict' + end]}")
    if row["flips"]:
        lines.append("  The verdict changes when problems that ended in errors are left out; report both.")
    if row["heterogeneous"]:
        lines.append("  Benchmarks point in different directions; the pooled difference hides that.")
    lines.append(f"  premises: named in {row['used']} of the proofs, in {row['needed']} of those that it alone has" if row["used"] is not None else "  premises: its proofs don't tell")
    return "\n".join(lines)
