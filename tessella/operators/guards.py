"""Guards: each gives the rows that must not be reported on, ``enforce`` refuses them loudly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import GuardError, refuse

#: Ways to fuse rankings.
FUSIONS = ("rrf", "interleave")


def enforce(offenders: DataFrame, why: str) -> None:
    """Raises ``GuardError`` with the first offender, if there is any."""
    refuse(offenders, why)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in several rows, and in how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def drift(runs: DataFrame, keys: list[str], settings: list[str]) -> DataFrame:
    """keys, setting, n_values: settings that differ between runs of the same keys; null is a value."""
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.coalesce(F.col(s).cast("string"), F.lit("null")).alias("value")) for s in settings])).alias("x")
    return runs.select(*keys, one).groupBy(*keys, "x.setting").agg(F.countDistinct("x.value").alias("n_values")).where("n_values > 1")


def drifted_settings(runs: DataFrame, keys: list[str], config: str, but: tuple[str, ...] = ()) -> DataFrame:
    """The same for a configuration held as JSON: every top-level setting that any run has."""
    kv = runs.select(*keys, "run", F.explode(F.from_json(F.col(config), "map<string,string>")).alias("setting", "value")).where(~F.col("setting").isin(*but))
    names = kv.select(*keys, "setting").distinct()
    all_ = runs.select(*keys, "run").join(names, keys).join(kv, [*keys, "run", "setting"], "left")
    return all_.groupBy(*keys, "setting").agg(F.countDistinct(F.coalesce("value", F.lit("\x00none"))).alias("n_values")).where("n_values > 1")


def seed_sets(draws: DataFrame, group: list[str], arm: str = "arm", seed: str = "seed") -> DataFrame:
    """group, arm, seeds of arms in groups whose arms haven't all the same seeds."""
    sets = draws.groupBy(*group, arm).agg(F.array_sort(F.collect_set(seed)).alias("seeds"))
    odd = sets.groupBy(*group).agg(F.countDistinct("seeds").alias("_n")).where("_n > 1").drop("_n")
    return sets.join(odd, group) if group else sets.crossJoin(odd)


def absent_arms(draws: DataFrame, wanted: list[str], group: str = "benchmark", arm: str = "arm") -> DataFrame:
    """arm and in how many groups it is, of wanted arms that aren't in all groups: those of 0 match nothing, the others can't be pooled."""
    spark = draws.sparkSession
    names = spark.createDataFrame([(w,) for w in wanted], "wanted string")
    have = draws.select(group, arm).distinct()
    groups = draws.select(group).distinct().agg(F.count("*").alias("n_groups"))
    found = names.join(have, (F.col(arm) == F.col("wanted")) | F.col(arm).startswith(F.concat("wanted", F.lit("@"))), "left").groupBy("wanted").agg(F.countDistinct(group).alias("n_found"))
    return found.crossJoin(F.broadcast(groups)).where("n_found < n_groups").select(F.col("wanted").alias("arm"), "n_found", "n_groups")


def ragged(runs: DataFrame, benchmark: str = "benchmark", n_problems: str = "n_problems", budget: list[str] | None = None) -> DataFrame:
    """Benchmarks whose runs differ in the number of problems or in the search budget."""
    b = F.struct(*(budget or ["max_expansions", "samples"]))
    return runs.groupBy(benchmark).agg(F.countDistinct(n_problems).alias("n_sizes"), F.countDistinct(b).alias("n_budgets")).where("n_sizes > 1 or n_budgets > 1")


def incomparable(pairs: DataFrame) -> DataFrame:
    """pairs: a_run, b_run, a_label, b_label, a_benchmark, b_benchmark, n_shared. With why two runs can't be compared; null reasons are left out."""
    reason = (F.when(F.col("a_run") == F.col("b_run"), "the same run").when(F.col("a_benchmark") != F.col("b_benchmark"), "different benchmarks")
              .when(F.col("a_label") == F.col("b_label"), "the same arm and budget").when(F.col("n_shared") == 0, "no problem in common"))
    return pairs.withColumn("reason", reason).where("reason is not null")


def unpoolable(contrasts: DataFrame) -> DataFrame:
    """contrasts: benchmark, baseline, treatment of each pair to be pooled. One row for each reason against it."""
    g = contrasts.agg(F.count("*").alias("n"), F.countDistinct("benchmark").alias("k"), F.countDistinct(F.struct("baseline", "treatment")).alias("c"))
    reasons = F.array(F.when(F.col("k") < 2, "fewer than two benchmarks"), F.when(F.col("k") < F.col("n"), "a benchmark more than once"), F.when(F.col("c") > 1, "different contrasts"))
    return g.select(F.explode(F.array_compact(reasons)).alias("reason"))


def identical_replicates(draws: DataFrame, keys: list[str], share: float = 1.0) -> DataFrame:
    """keys, seed, other, n_both, identical: pairs of seeds that solve their common problems by equal proofs in ``share`` and more of the cases; draws: keys, seed, pid, proof of what is solved."""
    x = draws.select(*keys, "pid", "seed", "proof")
    y = x.select(*keys, "pid", F.col("seed").alias("other"), F.col("proof").alias("proof2"))
    g = x.join(y, [*keys, "pid"]).where("seed < other").groupBy(*keys, "seed", "other").agg(F.count("*").alias("n_both"), F.avg((F.col("proof") == F.col("proof2")).cast("double")).alias("identical"))
    return g.where(F.col("identical") >= share)


def row_faults(attempts: DataFrame, expected: DataFrame, keys: list[str], problem: str = "pid") -> DataFrame:
    """keys, fault, n: problems with several rows, without one, and rows of problems that aren't expected (keys, problem)."""
    n = attempts.groupBy(*keys, problem).agg(F.count("*").alias("rows"))
    j = expected.withColumn("due", F.lit(True)).join(n, [*keys, problem], "full")
    fault = F.when(F.col("due").isNull(), "excess").when(F.col("rows").isNull(), "missing").when(F.col("rows") > 1, "duplicate")
    return j.withColumn("fault", fault).where("fault is not null").groupBy(*keys, "fault").agg(F.count("*").alias("n"))


def several_corpora(indices: DataFrame, group: str) -> DataFrame:
    """Groups whose indices were built from several corpora; indices that don't know theirs are left out."""
    return indices.groupBy(group).agg(F.countDistinct("corpus_id").alias("n_corpora")).where("n_corpora > 1")


def other_fingerprint(have: DataFrame, expected: str) -> DataFrame:
    return have.where(F.col("fingerprint") != expected)


def too_many_draws(k: Column, draws: Column) -> Column:
    """Whether a budget-matched comparison at ``k`` draws of two arms is impossible with so many draws of each."""
    return 2 * k > draws


def require_fusion(names: list[str], mode: str) -> None:
    """Two different retrievers at least, and a known way to fuse them."""
    if len(set(names)) < 2 or len(set(names)) < len(names):
        raise GuardError(f"fusion needs different retrievers, has {names}")
    if mode not in FUSIONS:
        raise GuardError(f"{mode} is none of {', '.join(FUSIONS)}")


def parse_seeds(text: str | None) -> set[int] | None:
    """``0-3,7`` as numbers; None means all, nothing is refused."""
    if text is None:
        return None
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        lo, sep, hi = part.partition("-")
        out |= set(range(int(lo), int(hi) + 1)) if sep else {int(lo)}
    if not out:
        raise GuardError(f"{text!r} names no seed")
    return out


def restrict(runs: DataFrame, arms: list[str] | None = None, seeds: set[int] | None = None, arm: str = "arm", seed: str = "seed") -> DataFrame:
    """Runs of some arms (with any budget) and seeds; None leaves a filter out."""
    if arms is not None:
        keep = F.lit(False)
        for a in arms:
            keep = keep | is_arm(F.col(arm), F.lit(a))
        runs = runs.where(keep)
    return runs if seeds is None else runs.where(F.col(seed).isin(*sorted(seeds)))


def is_arm(label: Column, wanted: Column) -> Column:
    """Whether a label is an arm, alone or with a budget behind an @."""
    return (label == wanted) | label.startswith(F.concat(wanted, F.lit("@")))


def arm_of(label: Column) -> Column:
    return F.substring_index(label, "@", 1)


def same_index(a: Column, b: Column) -> Column:
    """Whether two paths name one index: separators and a last slash don't count, and one may be the end of the other."""
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+$", "")
    a, b = plain(a), plain(b)
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def premise_free(n: int, share: float) -> tuple[int, int]:
    """How many of n samples are asked for with premises and without; a half goes to the even number, a split that leaves either side empty gives all to the first."""
    free = round(n * share)
    return (n, 0) if free <= 0 or free >= n or math.isnan(share) else (n - free, free)


def clamp(k: int, n: int, candidates: int | None = None) -> tuple[int, int]:
    """k within 0..n, and the number of candidates of a first stage: k at least, n at most."""
    k = max(0, min(k, n))
    return k, max(k, min(candidates if candidates is not None else n, n))
