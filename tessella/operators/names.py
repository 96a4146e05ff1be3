"""What a cited token may mean: the names of a corpus by themselves and by their last components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import stats
from ..functions.prompts import one_step_name
from ..functions.text import last_component
from .retrieval import small

#: Names of one last component that a task holds, about; a component with more is dealt out to several.
HEAVY = 10_000


def name_index(corpus: DataFrame, name: str = "name") -> DataFrame:
    """token, name, how: every name under itself (``exact``) and, if it has dots, under its last component (``suffix``). Null and empty names are none."""
    names = corpus.select(F.col(name).alias("name")).where("name <> ''").distinct()
    ways = F.array(F.struct(F.col("name").alias("token"), F.lit("exact").alias("how")), F.struct(last_component(F.col("name")).alias("token"), F.lit("suffix").alias("how")))
    return names.select("name", F.explode(ways).alias("w")).select("w.token", "name", "w.how").where("how = 'exact' or token <> name")


def resolve(tokens: DataFrame, index: DataFrame, token: str = "token", heavy: int = HEAVY) -> DataFrame:
    """token, name, how of each distinct token: itself where it is a name, otherwise all names that end in it; tokens that are neither have no row.

    ``index`` comes from ``name_index`` and is read twice. A last component that many names share is split by a hash of the
    name into parts of about ``heavy``, and only tokens that ask for it go to all its parts: no task holds more of it.
    """
    sizes = index.groupBy("token").agg(F.max(F.col("how") == "exact").alias("exact"), F.count_if(F.col("how") == "suffix").alias("n"))
    asked = tokens.select(F.col(token).alias("token")).where("token is not null").distinct().join(sizes, "token")
    asked = asked.select("token", F.when(F.col("exact"), "exact").otherwise("suffix").alias("how"), F.when(F.col("exact"), 1).otherwise(F.ceil(F.col("n") / heavy)).cast("int").alias("parts"))
    # There are at most as many heavy components as names, divided by ``heavy``.
    split = small(asked.where("parts > 1").select("token", "how", F.col("parts").alias("_parts")))
    dealt = index.join(split, ["token", "how"], "left").withColumn("part", F.pmod(F.xxhash64("name"), F.coalesce("_parts", F.lit(1))).cast("int"))
    wanted = asked.select("token", "how", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(wanted, ["token", "how", "part"]).select("token", "name", "how")


def seen_tokens(resolved: DataFrame, seen: DataFrame) -> DataFrame:
    """token, n_names, seen of resolved tokens: a token is seen if any name that it may mean is in ``seen`` (name)."""
    known = seen.select("name").where("name is not null").distinct().withColumn("_seen", F.lit(True))
    return resolved.join(known, "name", "left").groupBy("token").agg(F.count("*").alias("n_names"), F.bool_or(F.col("_seen").isNotNull()).alias("seen"))


def one_step(proofs: DataFrame, index: DataFrame, steps: str = "proof", loose: bool = False) -> DataFrame:
    """The columns of ``proofs`` with head, name, how: those that are one ``exact`` or ``apply`` of a token that resolves, a row for each name that it may mean."""
    heads = proofs.withColumn("head", one_step_name(F.col(steps), loose)).where("head is not null")
    return heads.join(resolve(heads, index, "head").withColumnRenamed("token", "head"), "head")


def novelty(cited: DataFrame, index: DataFrame, seen: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """keys, n_cited, n_unseen, unseen, any_unseen of each row of ``cited`` (keys, an array of distinct tokens).

    A token cites something if it resolves, and is unseen if none of the names that it may mean is in ``seen``. ``unseen`` is the
    share of cited tokens that are, null where nothing is cited.
    """
    one = cited.select(*keys, F.explode_outer(tokens).alias("token"))
    flags = seen_tokens(resolve(one, index), seen)
    g = one.join(flags, "token", "left").groupBy(*keys).agg(F.count("seen").alias("n_cited"), F.count_if(~F.col("seen")).alias("n_unseen"))
    some: Column = F.col("n_cited") > 0
    return g.withColumn("unseen", F.when(some, F.col("n_unseen") / F.col("n_cited"))).withColumn("any_unseen", F.when(some, F.col("n_unseen") > 0))


def stratum(problems: DataFrame, by: str) -> DataFrame:
    """by, n, n_citing, n_citing_unseen, rate (of all problems), mean_unseen (share, over those that cite), mean_cited, mean_n_unseen."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return problems.groupBy(by).agg(F.count("*").alias("n"), F.count("unseen").alias("n_citing"), F.count_if("any_unseen").alias("n_citing_unseen"),
                                    F.round(F.count_if("any_unseen") / F.count("*"), 6).alias("rate"), mean("unseen", "mean_unseen"), mean("n_cited", "mean_cited"), mean("n_unseen", "mean_n_unseen"))


def shuffled_p(values: list[float], a: list[int], b: list[int], n: int = 10_000, seed: int = 0) -> float:
    """Two-sided p of a difference of means when labels are dealt out anew ``n`` times: ``a`` and ``b`` say how often each value stands on either side.

    How many of each value a shuffle gives to the first side is a draw from a multivariate hypergeometric distribution, so the cost
    goes by distinct values, not by rows. 1 if a side is empty.
    """
    x, a, b = np.asarray(values, float), np.asarray(a, np.int64), np.asarray(b, np.int64)
    if not a.sum() or not b.sum():
        return 1.0
    seen = abs(b @ x / b.sum() - a @ x / a.sum())
    draws = np.random.default_rng(seed).multivariate_hypergeometric(a + b, a.sum(), size=n, method="marginals")
    far = np.abs((a + b - draws) @ x / b.sum() - draws @ x / a.sum()) >= seen - 1e-12
    return float((far.sum() + 1) / (n + 1))


@F.pandas_udf(DoubleType())
def _shuffled(values: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shuffled_p(list(v), list(x), list(y)) for v, x, y in zip(values, a, b, strict=True)])


def exclusive(problems: DataFrame, contrasts: list[tuple[str, str]]) -> DataFrame:
    """a, b, benchmark, pid, side (0: only a has solved it, 1: only b), unseen, any_unseen. problems: benchmark, pid, arm, unseen, any_unseen of what each arm has solved."""
    sides = F.broadcast(problems.sparkSession.createDataFrame([(arm, a, b, i) for a, b in contrasts for i, arm in enumerate((a, b))], "arm string, a string, b string, side int"))
    g = problems.join(sides, "arm").groupBy("a", "b", "benchmark", "pid").agg(F.count_distinct("side").alias("n"), F.first("side").alias("side"), F.first("unseen").alias("unseen"), F.first("any_unseen").alias("any_unseen"))
    return g.where("n = 1").drop("n")


def novelty_contrasts(problems: DataFrame, contrasts: list[tuple[str, str]]) -> DataFrame:
    """a, b, n_a, n_b, a_unseen, a_seen, b_unseen, b_seen, mean_a, mean_b, p_fisher, p_shuffled of problems that one side of a contrast alone has solved.

    Do they cite unseen names more often on one side (exact test of the four counts), and is their share of unseen names another (labels shuffled
    10,000 times)? Problems that cite nothing count in n_a and n_b alone. A contrast's row is made of how often each share occurs; shares are fractions of
    a proof's few tokens.
    """
    own = exclusive(problems, contrasts)
    side = lambda i, c: F.count_if((F.col("side") == i) & c)
    every, some = F.lit(True), F.col("any_unseen")
    counts = own.groupBy("a", "b").agg(side(0, every).alias("n_a"), side(1, every).alias("n_b"), side(0, some).alias("a_unseen"), side(0, ~some).alias("a_seen"), side(1, some).alias("b_unseen"), side(1, ~some).alias("b_seen"),
                                       *[F.round(F.avg(F.when(F.col("side") == i, F.col("unseen"))), 6).alias(f"mean_{x}") for i, x in enumerate("ab")])
    values = own.where("unseen is not null").groupBy("a", "b", "unseen").agg(side(0, every).alias("x"), side(1, every).alias("y"))
    values = values.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("unseen", "x", "y"))).alias("v"))
    p = values.select("a", "b", F.round(_shuffled(F.col("v.unseen"), F.col("v.x"), F.col("v.y")), 6).alias("p_shuffled"))
    fisher = stats.fisher(F.col("a_unseen"), F.col("a_seen"), F.col("b_unseen"), F.col("b_seen"))
    return counts.withColumn("p_fisher", F.round(fisher, 6)).join(p, ["a", "b"], "left").fillna(1.0, ["p_shuffled"])
