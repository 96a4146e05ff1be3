"""Reports over paired runs: differences with intervals and exact tests, what proofs cite, what the loser did, cost of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import runs

#: Hours (retrieval, generation) of a measured run of 64 expansions with 16 samples, problems of each benchmark, and milliseconds of a query.
MEASURED = [
    ("proofnet_test", "none", 0.00, 1.78), ("proofnet_test", "sv", 0.06, 1.88), ("proofnet_test", "li", 1.59, 1.86),
    ("fate_m", "none", 0.00, 0.83), ("fate_m", "sv", 0.04, 0.94), ("fate_m", "li", 1.09, 0.99),
]
SIZES = [("fate_m", 141), ("proofnet_test", 186), ("minif2f_test", 244)]
QUERY_MS = {"proofnet_test": 1070.7, "fate_m": 936.5}
FUSION_MS, WITHOUT_PREMISES, SAFETY = 520.0, 1.06, 1.25


def differences(paired: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """benchmark, pid, x: treatment less baseline."""
    return paired.select("benchmark", "pid", (F.col(b).cast("double") - F.col(a).cast("double")).alias("x"))


def resample(values: DataFrame, n: int, seed: str, keys: list[str], group: list[str]) -> DataFrame:
    """group, b, mean, flipped: per resample the mean of ``x`` under weights of a Poisson bootstrap, and the mean of the values other than 0 under random signs.

    A value's weight and sign come from a counter-based hash of resample and keys, so rows need no index, never meet in
    one task and give the same result in any engine: sums are combined on the map side.
    """
    rows = values.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("h", stats.draw(F.lit(seed), F.col("b").cast("string"), *[F.col(k).cast("string") for k in keys]))
    rows = rows.withColumn("w", poisson(F.col("h") / F.lit(4294967296.0))).withColumn("sign", F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0))
    return rows.groupBy(*group, "b").agg((F.sum(F.col("w") * F.col("x")) / F.greatest(F.sum("w"), F.lit(1.0))).alias("boot"), (F.sum(F.col("sign") * F.col("x")) / F.greatest(F.count_if(F.col("x") != 0), F.lit(1))).alias("flipped"))


#: The distribution function of a Poisson variable of mean 1 at 0 to 8.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402]


def poisson(u: Column) -> Column:
    """A Poisson variable of mean 1 from a uniform one."""
    out = F.lit(0.0)
    for p in POISSON:
        out = out + F.when(u >= p, 1.0).otherwise(0.0)
    return out


def tested(values: DataFrame, n: int = 200, seed: str = "0", keys: tuple[str, ...] = ("benchmark", "pid"), group: tuple[str, ...] = ()) -> DataFrame:
    """group, n, mean, lo, hi (95 % interval), p (sign flips; 1 if all differences are 0), verdict, agree (whether interval and test say the same)."""
    group_ = list(group)
    o = values.groupBy(*group_).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.count_if(F.col("x") != 0).alias("nz"), (F.abs(F.sum("x")) / F.greatest(F.count_if(F.col("x") != 0), F.lit(1))).alias("obs"))
    r = resample(values, n, seed, list(keys), group_)
    j = r.join(F.broadcast(o), group_) if group_ else r.crossJoin(F.broadcast(o))
    g = j.groupBy(*group_, "n", "m", "nz").agg(F.percentile("boot", F.lit(0.025)).alias("lo"), F.percentile("boot", F.lit(0.975)).alias("hi"), ((F.count_if(F.abs("flipped") >= F.col("obs") - 1e-12) + 1) / F.lit(n + 1)).alias("p"))
    p, lo, hi = F.when(F.col("nz") == 0, 1.0).otherwise(F.col("p")), F.round("lo", 6), F.round("hi", 6)
    return g.select(*group_, "n", F.round("m", 6).alias("mean"), lo.alias("lo"), hi.alias("hi"), F.round(p, 6).alias("p"), stats.verdict(lo, hi, p).alias("verdict"), agrees(lo, hi, p).alias("agree"))


def stream_tests(d, n: int = 10_000, seed: int = 0, cells: int = 4_000_000) -> tuple[float, float, float]:
    """lo, hi of a percentile bootstrap and p of sign flips for paired differences ``d`` in order, from one seeded generator: first all resamples, then all signs, in blocks of bounded size."""
    import numpy as np

    d = np.asarray(d, float)
    rng = np.random.default_rng(seed)
    blocks = lambda width: [min(max(1, cells // max(1, width)), n - i) for i in range(0, n, max(1, cells // max(1, width)))]
    means = np.concatenate([d[rng.integers(0, len(d), size=(k, len(d)))].mean(axis=1) for k in blocks(len(d))])
    lo, hi = np.quantile(means, [0.025, 0.975])
    nz = d[d != 0]
    if not len(nz):
        return float(lo), float(hi), 1.0
    hits = sum(int((np.abs((rng.choice([-1.0, 1.0], size=(k, len(nz))) * nz).mean(axis=1)) >= abs(nz.mean())).sum()) for k in blocks(len(nz)))
    return float(lo), float(hi), (hits + 1) / (n + 1)


def agrees(lo: Column, hi: Column, p: Column) -> Column:
    """Whether an interval around 0 and a test at 5 % say the same."""
    return ((lo <= 0) & (hi >= 0)) == (p >= 0.05)


def exclusive_lists(paired: DataFrame) -> DataFrame:
    """benchmark, only_a, only_b: sorted problems that one side alone has solved."""
    one = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("pid"))))
    return paired.where(F.col("a") != F.col("b")).groupBy("benchmark").agg(one(F.col("a")).alias("only_a"), one(F.col("b")).alias("only_b"))


def heterogeneous(by_benchmark: DataFrame, delta: str = "delta") -> DataFrame:
    """Whether benchmarks point in different directions; those without a difference don't count."""
    return by_benchmark.agg((F.countDistinct(F.when(F.col(delta) != 0, F.signum(delta))) > 1).alias("heterogeneous"))


def premise_rates(paired: DataFrame) -> DataFrame:
    """n_solved, n_used, used, n_only, n_needed, needed: of all proofs of the treatment those that name a premise, and of its exclusive ones. paired: a, b, names (does the proof name one; null if that can't be told). Shares are null where nothing can be told."""
    g = paired.agg(F.count_if("b").alias("n_solved"), F.count_if(F.col("b") & F.col("names")).alias("n_used"), F.count_if(F.col("b") & ~F.col("a")).alias("n_only"), F.count_if(F.col("b") & ~F.col("a") & F.col("names")).alias("n_needed"), F.count_if(F.col("b") & F.col("names").isNotNull()).alias("known"))
    share = lambda x, n: F.when((F.col("known") > 0) & (F.col(n) > 0), F.round(F.col(x) / F.col(n), 6))
    return g.select("n_solved", "n_used", share("n_used", "n_solved").alias("used"), "n_only", "n_needed", share("n_needed", "n_only").alias("needed"))


def loser_profile(draws: DataFrame, winner: str, loser: str) -> DataFrame:
    """status, n, median expansions where the search was exhausted (a missing count is 0): the loser's attempts at what the winner alone has solved. draws: benchmark, arm, pid, seed, solved, status, n_expansions."""
    p = runs.pairs(draws, winner, loser).where("a and not b").select("benchmark", "pid")
    own = draws.where(F.col("arm") == loser).join(p, ["benchmark", "pid"], "left_semi")
    return own.groupBy("status").agg(F.count("*").alias("n"), F.median(F.when(F.col("status") == "exhausted", F.coalesce("n_expansions", F.lit(0)))).alias("median_expansions"))


def discordance(wins: DataFrame, heads_shown: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of exclusive wins (arm, mode of the loser, n_steps, n_expansions, heads, area, one_step): a summary, the most frequent heads and the areas of each arm.

    Heads of equal frequency go by first appearance if ``wins`` has a column ``ord`` that orders them (and then by place in the proof), by name
    otherwise. It describes, it doesn't test.
    """
    med = lambda c: F.round(F.median(c), 1)
    summary = wins.groupBy("arm").agg(F.count("*").alias("n"), med("n_steps").alias("steps"), med("n_expansions").alias("expansions"), F.count_if("one_step").alias("n_one_step"), F.count_if(F.col("mode") == "max_expansions").alias("n_loser_at_limit"))
    order = F.struct("ord", "pos") if "ord" in wins.columns else F.lit(0)
    heads = wins.select("arm", *(["ord"] if "ord" in wins.columns else []), F.posexplode("heads").alias("pos", "head")).groupBy("arm", "head").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = Window.partitionBy("arm").orderBy(F.col("n").desc(), "_first", "head")
    heads = heads.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= heads_shown).drop("_first")
    return summary, heads, wins.groupBy("arm", "area").agg(F.count("*").alias("n"))


def policy_stats(counters: DataFrame, by: str) -> DataFrame:
    """Means for each expansion and each candidate, and rates, of summed counters (by, n_prompts, n_free, n_generated, n_empty, n_cheats, n_kept, chars, logprob); null where there is nothing to divide by."""
    total = counters.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n_prompts", "n_free", "n_generated", "n_empty", "n_cheats", "n_kept", "chars", "logprob")])
    rate = lambda x, n, places: F.round(F.col(x) / F.nullif(n, F.lit(0)), places)
    return total.select(by, "n_prompts", "n_generated", "n_kept", rate("chars", F.col("n_prompts") + F.col("n_free"), 1).alias("mean_prompt_chars"), rate("n_kept", F.col("n_prompts"), 2).alias("mean_candidates"),
                        rate("logprob", F.col("n_kept"), 4).alias("mean_logprob"), rate("n_cheats", F.col("n_generated"), 4).alias("cheat_rate"), rate("n_empty", F.col("n_generated"), 4).alias("empty_rate"))


def candidates(generations: DataFrame, n: int = 32, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """keys, step, score, rank: a model's answers as steps. generations: keys, raw, logprob, n_tokens. Refused ones go, of equal ones the best stays, a score that is no number counts as the lowest."""
    from pyspark.sql import Window

    from ..functions import prompts

    x = generations.withColumn("p", prompts.proposed(F.col("raw"))).where("p.reason is null")
    s = prompts.mean_logprob(F.col("logprob"), F.col("n_tokens"))
    score = F.when(s.isNull() | F.isnan(s), F.lit(float("-inf"))).otherwise(s)
    best = x.groupBy(*keys, F.col("p.step").alias("step")).agg(F.max(score).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "step"))).where(F.col("rank") <= n)


def root_candidates(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean, best of the finite logprobs at depth 0 of each trace; a trace without any is left out."""
    one = attempts.select(*keys, F.explode("trace").alias("t")).where("t.depth = 0 and t.logprob is not null and not isnan(t.logprob) and abs(t.logprob) < double('infinity')")
    return one.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("t.logprob").alias("mean"), F.max("t.logprob").alias("best"))


def paired_roots(roots: DataFrame, stat: str = "mean") -> DataFrame:
    """a, b, n, delta for every ordered pair of arms: the mean difference of a statistic over problems that both have. roots: benchmark, pid, arm and the statistic."""
    y = roots.select("benchmark", "pid", F.col("arm").alias("b"), F.col(stat).alias("y"))
    j = roots.select("benchmark", "pid", F.col("arm").alias("a"), F.col(stat).alias("x")).join(y, ["benchmark", "pid"]).where("a <> b")
    return j.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("delta"))


def budget_matched(draws: DataFrame, a: str, b: str, k: int, n_draws: int) -> DataFrame:
    """benchmark, pid and the chances that it is solved: ``both`` by k draws of each arm, ``a`` and ``b`` by 2k draws of one. Refused if 2k draws can't be had."""
    if 2 * k > n_draws:
        raise runs.GuardError(f"2 * {k} draws of one arm need more than {n_draws}")
    c = draws.where(F.col("arm").isin(a, b)).groupBy("benchmark", "pid", "arm").agg(F.count_if("solved").alias("c"))
    one = lambda arm: F.coalesce(F.max(F.when(F.col("arm") == arm, F.col("c"))), F.lit(0))
    # k seeds of both arms: what any arm solves at a seed is solved there.
    either = draws.where(F.col("arm").isin(a, b)).groupBy("benchmark", "pid", "seed").agg(F.bool_or("solved").alias("s")).groupBy("benchmark", "pid").agg(F.count_if("s").alias("ce"))
    g = c.groupBy("benchmark", "pid").agg(one(a).alias("ca"), one(b).alias("cb")).join(either, ["benchmark", "pid"])
    p = lambda c, k: stats.pass_at_k(F.lit(n_draws), F.col(c), F.lit(k))
    return g.select("benchmark", "pid", p("ce", k).alias("both"), p("ca", 2 * k).alias("a"), p("cb", 2 * k).alias("b"))


def noise_and_contrast(draws: DataFrame, a: str, b: str) -> DataFrame:
    """kind, n_pairs, lo, mean, hi of the share of problems on which two seeds differ, and of what the union gains over the better: within each arm and across the two; ``above`` where the mean across is beyond the largest within."""
    x = draws.where(F.col("arm").isin(a, b)).select("benchmark", "pid", "arm", "seed", "solved")
    y = x.select("benchmark", "pid", F.col("arm").alias("arm2"), F.col("seed").alias("seed2"), F.col("solved").alias("solved2"))
    within, across = (F.col("arm") == F.col("arm2")) & (F.col("seed") < F.col("seed2")), (F.col("arm") == a) & (F.col("arm2") == b)
    j = x.join(y, ["benchmark", "pid"]).where(within | across).withColumn("kind", F.when(across, "across").otherwise(F.concat(F.lit("within "), F.col("arm"))))
    g = j.groupBy("kind", "seed", "seed2").agg((F.count_if(F.col("solved") != F.col("solved2")) / F.count("*")).alias("d"), (F.count_if(F.col("solved") | F.col("solved2")) - F.greatest(F.count_if("solved"), F.count_if("solved2"))).alias("gain"))
    r = g.groupBy("kind").agg(F.count("*").alias("n_pairs"), *[f(c).alias(f"{c}_{n}") for c in ("d", "gain") for n, f in (("lo", F.min), ("mean", F.avg), ("hi", F.max))])
    floor = r.where("kind <> 'across'").agg(F.max("d_hi").alias("f"))
    return r.crossJoin(F.broadcast(floor)).select("kind", "n_pairs", *[F.round(c, 6).alias(c) for c in r.columns[2:]], F.when(F.col("kind") == "across", F.col("d_mean") > F.col("f")).alias("above"))


def project_hours(requests: DataFrame) -> DataFrame:
    """requests (benchmark, arm, expansions, samples, n_problems, premise_free) with ``hours``: a measured run scaled to the request, with both surcharges where it isn't the measured point; null for what was never measured."""
    spark = requests.sparkSession
    base = spark.createDataFrame(MEASURED, "benchmark string, _arm string, _r double, _g double")
    sizes = spark.createDataFrame(SIZES, "benchmark string, _n int")
    fused = F.col("arm") == "fusion"
    ms = F.create_map(*[F.lit(x) for kv in QUERY_MS.items() for x in kv])
    li = F.element_at(ms, F.col("benchmark"))
    factor = F.when(fused, F.coalesce((li + FUSION_MS) / li, F.lit(1 + FUSION_MS / 1000))).otherwise(1.0)
    j = requests.withColumn("_arm", F.when(fused, "li").otherwise(F.col("arm"))).join(F.broadcast(base), ["benchmark", "_arm"], "left").join(F.broadcast(sizes), "benchmark", "left")
    more = F.col("expansions") / 64
    free = F.coalesce("premise_free", F.lit(0.0)) > 0
    hours = (F.col("_r") * factor * more + F.col("_g") * more * F.col("samples") / 16) * F.when(free, WITHOUT_PREMISES).otherwise(1.0)
    hours = hours * F.when((F.col("expansions") != 64) | (F.col("samples") != 16) | free | fused, SAFETY).otherwise(1.0)
    return j.withColumn("hours", hours * F.when(F.col("n_problems") > 0, F.col("n_problems") / F.coalesce("_n", "n_problems")).otherwise(1.0)).select(*requests.columns, "hours")


def budgets(runs_: DataFrame) -> DataFrame:
    """benchmark, max_expansions, samples, n_runs, arms: runs of one search budget."""
    return runs_.groupBy("benchmark", "max_expansions", "samples").agg(F.count("*").alias("n_runs"), F.array_sort(F.collect_set("arm")).alias("arms"))


def markdown(rows: list, columns: list[str]) -> str:
    """A collected result as a table of text; missing values are dashes."""
    show = lambda x: "—" if x is None else (f"{x:.4g}" if isinstance(x, float) else str(x))
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])


def served(queries: DataFrame, make, schema: str) -> DataFrame:
    """Queries answered by a retriever that ``make`` builds once in each task's own process: ``make()`` gives a function from a pandas frame of queries to one of results."""

    def run(batches):
        answer = make()
        for rows in batches:
            yield answer(rows)

    return queries.mapInPandas(run, schema)
