"""Run logs: draws, set algebra between arms, paired comparisons, resampling, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


class GuardError(ValueError):
    """A result that must not be reported, and why."""


def refuse(bad: DataFrame, why: str) -> None:
    """Raises if ``bad`` has a row."""
    row = bad.limit(1).collect()
    if row:
        raise GuardError(f"{why}: {row[0].asDict()}")


def require_same_seeds(draws: DataFrame) -> None:
    seeds = draws.groupBy("arm").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    if seeds.select("seeds").distinct().count() > 1:
        raise GuardError("arms have different seeds")


def require_unique(df: DataFrame, *keys: str) -> None:
    refuse(df.groupBy(*keys).count().where("count > 1"), f"duplicate {keys}")


def require_rows(df: DataFrame, n: int) -> None:
    if (have := df.count()) != n:
        raise GuardError(f"{have} rows, expected {n}")


def last_rows(attempts: DataFrame, *keys: str, order: str = "line_no") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in attempts.columns if c not in keys]
    return attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def discounted(attempts: DataFrame, failures: DataFrame, *keys: str) -> DataFrame:
    """``solved`` only where no verification failure has the key; ``discounted`` tells which were."""
    f = failures.select(*keys, F.lit(True).alias("_f")).distinct()
    j = attempts.join(f, list(keys), "left")
    return j.withColumn("discounted", F.col("solved") & F.coalesce("_f", F.lit(False))).withColumn("solved", F.col("solved") & F.col("_f").isNull()).drop("_f")


def by_arm(draws: DataFrame) -> DataFrame:
    """An arm solves what any of its seeds solves."""
    return draws.groupBy("benchmark", "arm", "pid").agg(F.bool_or("solved").alias("solved"), F.count("*").alias("n_draws"), F.count_if("solved").alias("n_solved"))


def pairs(draws: DataFrame, a: str, b: str, without_errors: bool = False) -> DataFrame:
    """Problems that both arms have tried: benchmark, pid, a, b (solved by each); if asked for, without those where either has a row of status error."""
    if without_errors:
        bad = draws.where(F.col("arm").isin(a, b) & (F.col("status") == "error")).select("benchmark", "pid").distinct()
        draws = draws.join(bad, ["benchmark", "pid"], "left_anti")
    arms = by_arm(draws)
    left = arms.where(F.col("arm") == a).select("benchmark", "pid", F.col("solved").alias("a"))
    return left.join(arms.where(F.col("arm") == b).select("benchmark", "pid", F.col("solved").alias("b")), ["benchmark", "pid"])


def compare(paired: DataFrame) -> DataFrame:
    """Per benchmark and over all (benchmark null): counts of both, either and neither, difference of rates, exact McNemar p."""
    one = lambda c: F.count_if(c)
    g = paired.rollup("benchmark").agg(
        F.count("*").alias("n"), one(F.col("a")).alias("n_a"), one(F.col("b")).alias("n_b"), one(F.col("a") & F.col("b")).alias("both"),
        one(F.col("a") & ~F.col("b")).alias("only_a"), one(~F.col("a") & F.col("b")).alias("only_b"), one(F.col("a") | F.col("b")).alias("either"))
    return g.withColumn("delta", F.round((F.col("n_b") - F.col("n_a")) / F.col("n"), 6)).withColumn("union_gain", F.col("either") - F.greatest("n_a", "n_b")).withColumn("union_rate", F.round(F.col("either") / F.col("n"), 6)).withColumn("p", F.round(stats.mcnemar(F.col("only_a"), F.col("only_b")), 6)).withColumn("baseline_is_subset", F.col("only_a") == 0)


def solve_rates(draws: DataFrame) -> DataFrame:
    """Share of an arm's draws that solve each problem, of problems that every draw of the arm has tried."""
    seeds = draws.groupBy("benchmark", "arm").agg(F.countDistinct("seed").alias("k"))
    return draws.groupBy("benchmark", "arm", "pid").agg(F.avg(F.col("solved").cast("double")).alias("rate"), F.count("*").alias("n")).join(seeds, ["benchmark", "arm"]).where("n = k").select("benchmark", "arm", "pid", "rate")


def coverage(draws: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, draws taken, mean pass@k over all problems that any draw has tried; a missing draw counts as unsolved."""
    c = draws.groupBy(*dict.fromkeys([*keys, "benchmark", "pid"])).agg(F.countDistinct(F.when(F.col("solved"), F.col("seed"))).alias("c"))
    return (c.groupBy(*keys, "c").count().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("p", stats.pass_at_k(F.lit(k), F.col("c"), F.col("k"))).groupBy(*keys, "k").agg(F.round(F.sum(F.col("p") * F.col("count")) / F.sum("count"), 6).alias("coverage")))


def coverage_of_first(draws: DataFrame, k: int, order: str, *keys: str) -> DataFrame:
    """keys, draws taken, pass@k summed over all problems and divided by the number of problems that the first draw (by ``order``) has tried.

    That number is the benchmark's size where the first draw is whole, whatever later draws have left out; a problem that only a later
    draw has tried adds to the sum. ``keys`` name the groups of draws, each with ``k`` draws.
    """
    at = list(dict.fromkeys([*keys, "benchmark", "pid"]))
    of = draws.groupBy(*keys).agg(F.min(order).alias("_first"))
    first = draws.join(of, list(keys)) if keys else draws.crossJoin(F.broadcast(of))
    n = first.where(F.col(order) == F.col("_first")).select(*at).distinct().groupBy(*keys).agg(F.count("*").alias("_n"))
    c = draws.groupBy(*at).agg(F.countDistinct(F.when(F.col("solved"), F.col("seed"))).alias("c")).groupBy(*keys, "c").count()
    p = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("p", stats.pass_at_k(F.lit(k), F.col("c"), F.col("k"))).groupBy(*keys, "k").agg(F.sum(F.col("p") * F.col("count")).alias("p"))
    j = p.join(n, list(keys)) if keys else p.crossJoin(F.broadcast(n))
    return j.select(*keys, "k", F.round(F.col("p") / F.col("_n"), 6).alias("coverage"), F.col("_n").alias("n_problems"))


def resampled(values: DataFrame, key: str, value: str, n: int, draw: Column, keep: str) -> DataFrame:
    """n resamples of the mean of ``value``: each row meets each resample, sums are combined on the map side."""
    rows = values.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("w", draw).groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.count("*")).alias(keep))


def interval(means: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    return means.agg(F.round(F.percentile(col, F.lit(alpha / 2)), 6).alias("lo"), F.round(F.percentile(col, F.lit(1 - alpha / 2)), 6).alias("hi"))


def latest(runs: DataFrame, keys: list[str], started: str, tie: str) -> DataFrame:
    """The most recent run of each key; of equal times the first by ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(started).desc(), F.col(tie))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
