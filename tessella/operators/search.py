"""Best-first search over a table of transitions: small problems one per group in tasks, large ones in rounds over tables.

Both ways give the same. A problem whose transitions fit a task is searched there with a heap. One with more has its frontier and the states
that it has seen as tables: each round takes every such problem's best node, joins it with its transitions and leaves out what has been seen.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

SCHEMA = "problem long, status string, proof array<string>, n_expansions int, n_tactics int, n_calls int, elapsed_s double, limit_hit string"
_INPUT = ["problem", "state", "tactic", "logprob", "outcome", "next", "elapsed_s"]


@dataclass(frozen=True)
class Limits:
    """How far a search goes: nodes that are expanded, steps of each, length of a proof, seconds of all steps (None: any), exponent of the length in a node's score."""

    max_expansions: int = 64
    per_step: int = 16
    max_depth: int = 32
    wall_clock_s: float | None = None
    penalty: float = 0.5


#: The search of published results.
LARGE = Limits(max_expansions=1024, per_step=64)


def _search(options: dict[int, list[tuple]], limits: Limits) -> tuple:
    """options: by state, (-logprob, step, logprob, outcome, next, elapsed_s)."""
    for rows in options.values():
        rows.sort()
    if any(r[3] == "closed" for r in options.get(0, ())):
        return "error", None, 0, 0, 0, 0.0, None
    order, seen, expanded, tried, calls, clock, hit = itertools.count(), {0}, 0, 0, 0, 0.0, None
    late = lambda: limits.wall_clock_s is not None and clock > limits.wall_clock_s
    todo = [(0.0, next(order), 0, 0.0, ())]
    while todo and not hit:
        if late():
            hit = "wall_clock_s"
            break
        if expanded >= limits.max_expansions:
            hit = "max_expansions"
            break
        _, _, state, logprob, path = heapq.heappop(todo)
        if len(path) >= limits.max_depth:
            continue
        expanded += 1
        for _, step, gain, outcome, to, seconds in options.get(state, ())[:limits.per_step]:
            if late():
                hit = "wall_clock_s"
                break
            tried, calls, clock = tried + 1, calls + (outcome != "rejected"), clock + seconds
            if outcome == "proved":
                return "proved", [*path, step], expanded, tried, calls, clock, None
            if outcome == "crash":
                return "error", None, expanded, tried, calls, clock, None
            if outcome == "progress" and to not in seen:
                seen.add(to)
                total, steps = logprob + gain, (*path, step)
                heapq.heappush(todo, (-total / len(steps) ** limits.penalty, next(order), to, total, steps))
    return "exhausted" if hit or todo else "no_candidates", None, expanded, tried, calls, clock, hit


def _input(transitions: DataFrame) -> DataFrame:
    seconds = F.coalesce(F.col("elapsed_s").cast("double"), F.lit(0.0)) if "elapsed_s" in transitions.columns else F.lit(0.0)
    return transitions.withColumn("elapsed_s", seconds).select(_INPUT)


def best_first(transitions: DataFrame, max_expansions: int = 64, per_step: int = 16, max_depth: int = 32, penalty: float = 0.5, wall_clock_s: float | None = None, task_rows: int = 1_000_000) -> DataFrame:
    """problem, status, proof, n_expansions, n_tactics, n_calls (steps that weren't rejected unseen), elapsed_s, limit_hit.

    transitions: problem, state, tactic, logprob, outcome (proved, progress, error, rejected, crash) and next, and elapsed_s if steps take
    time; a search begins at state 0. A problem without a state 0 has no candidates; one whose state 0 has a row of outcome ``closed`` has no goals
    to begin with, which is an error. Problems of more than ``task_rows`` transitions are searched in rounds.
    """
    limits = Limits(max_expansions, per_step, max_depth, wall_clock_s, penalty)
    rows = _input(transitions)
    sizes = rows.groupBy("problem").agg(F.count("*").alias("n")).where(F.col("n") > task_rows).select("problem")
    if not sizes.limit(1).count():
        return in_tasks(rows, limits)
    large = stored(sizes, "search-large")
    return in_tasks(rows.join(large, "problem", "left_anti"), limits).unionByName(in_rounds(rows.join(large, "problem", "left_semi"), limits))


def in_tasks(rows: DataFrame, limits: Limits) -> DataFrame:
    """Problems are sorted within partitions and searched one after another; a task holds the transitions of one problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, options = None, {}
        done = []

        def close():
            if now is not None:
                done.append((now, *_search(options, limits)))

        for frame in batches:
            for problem, state, step, logprob, outcome, to, seconds in frame.itertuples(index=False, name=None):
                if problem != now:
                    close()
                    now, options = problem, {}
                options.setdefault(state, []).append((-logprob, step, logprob, outcome, to, seconds))
            yield _frame(done)
            done.clear()
        close()
        yield _frame(done)

    return rows.repartition("problem").sortWithinPartitions("problem").mapInPandas(run, SCHEMA)


def in_rounds(rows: DataFrame, limits: Limits) -> DataFrame:
    """The same, a node of every problem in each round: as many rounds as a search may expand nodes at most. Each round's tables are written, and read by the next one."""
    by_state = Window.partitionBy("problem", "state").orderBy(F.desc("logprob"), "tactic", "outcome", "next", "elapsed_s")
    options = stored(rows.withColumn("rank", F.row_number().over(by_state)).where(F.col("rank") <= limits.per_step), "search-options")
    none = lambda kind: F.lit(None).cast(kind)
    closed = rows.where("state = 0 and outcome = 'closed'").select("problem").distinct().withColumn("closed", F.lit(True))
    ended = F.col("closed").isNotNull()
    runs = stored(rows.select("problem").distinct().join(closed, "problem", "left").select(
        "problem", F.when(ended, "error").alias("status"), none("array<string>").alias("proof"), F.lit(0).alias("n_expansions"), F.lit(0).alias("n_tactics"), F.lit(0).alias("n_calls"), F.lit(0.0).alias("elapsed_s"), none("string").alias("limit_hit")), "search-runs")
    todo = runs.where("status is null").select("problem", F.lit(0.0).alias("key"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("state"), F.lit(0.0).alias("logprob"), F.array().cast("array<string>").alias("path"))
    todo, seen = stored(todo, "search-todo"), stored(todo.select("problem", "state"), "search-seen")
    done = runs.where("status is not null")
    for turn in range(limits.max_expansions + 1):
        done = done.unionByName(runs.where("status is not null")) if turn else done
        done, runs, todo = _stopped(done, runs.where("status is null"), todo, turn, limits)
        if not runs.limit(1).count():
            break
        node = todo.where(F.size("path") < limits.max_depth).groupBy("problem").agg(F.min(F.struct("key", "ord", "state", "logprob", "path")).alias("b")).select("problem", "b.*")
        tried = stored(_tried(node, runs, options, limits), "search-tried")
        runs = stored(_after(tried, runs), "search-runs")
        going = runs.where("status is null").select("problem")
        child = tried.where("tried and outcome = 'progress'").groupBy("problem", F.col("next").alias("to")).agg(F.min(F.struct("rank", "tactic", "logprob", "total", "path")).alias("c"))
        child = child.join(seen.withColumnRenamed("state", "to"), ["problem", "to"], "left_anti").join(going, "problem", "left_semi")
        path = F.concat("c.path", F.array("c.tactic"))
        child = child.select("problem", (-(F.col("c.total")) / F.pow(F.size(path).cast("double"), F.lit(limits.penalty))).alias("key"), (F.lit((turn + 1) * (limits.per_step + 1)) + F.col("c.rank")).cast("long").alias("ord"), F.col("to").alias("state"), F.col("c.total").alias("logprob"), path.alias("path"))
        child = stored(child, "search-children")
        taken = node.select("problem", F.struct("key", "ord").alias("at"))
        left = todo.join(taken, "problem").where(F.struct("key", "ord") > F.col("at")).drop("at").join(going, "problem", "left_semi")
        todo = stored(left.unionByName(child), "search-todo")
        seen = stored(seen.join(going, "problem", "left_semi").unionByName(child.select("problem", "state")), "search-seen")
    return done.select([c.strip().split()[0] for c in SCHEMA.split(", ")])


def _stopped(done: DataFrame, runs: DataFrame, todo: DataFrame, turn: int, limits: Limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Takes runs out that have nothing left, or that have reached a limit."""
    left = todo.groupBy("problem").agg(F.count("*").alias("left"), F.count_if(F.size("path") < limits.max_depth).alias("open"))
    late = F.col("elapsed_s") > limits.wall_clock_s if limits.wall_clock_s is not None else F.lit(False)
    state = F.when(F.col("left").isNull(), "no_candidates").when(late, "wall_clock_s").when(F.lit(turn >= limits.max_expansions), "max_expansions").when(F.col("open") == 0, "no_candidates")
    judged = runs.join(left, "problem", "left").withColumn("end", state)
    over = judged.where("end is not null").withColumn("status", F.when(F.col("end") == "no_candidates", "no_candidates").otherwise("exhausted")).withColumn("limit_hit", F.when(F.col("end") != "no_candidates", F.col("end")))
    runs = stored(judged.where("end is null").drop("left", "open", "end"), "search-runs")
    return stored(done.unionByName(over.drop("left", "open", "end")), "search-done"), runs, todo.join(runs.select("problem"), "problem", "left_semi")


def _tried(node: DataFrame, runs: DataFrame, options: DataFrame, limits: Limits) -> DataFrame:
    """The options of each run's node with ``tried``: those before and up to the first that ends the search, as far as the clock allows."""
    w = Window.partitionBy("problem").orderBy("rank")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = node.withColumnRenamed("logprob", "sum").join(runs.select("problem", F.col("elapsed_s").alias("clock")), "problem").join(options, ["problem", "state"], "left")
    in_time = F.col("clock") + F.coalesce(F.sum("elapsed_s").over(past), F.lit(0.0)) <= limits.wall_clock_s if limits.wall_clock_s is not None else F.lit(True)
    ends = F.col("outcome").isin("proved", "crash")
    rows = rows.withColumn("in_time", in_time).withColumn("before", F.coalesce(F.sum(ends.cast("int")).over(past), F.lit(0)))
    here = F.col("rank").isNotNull() & (F.col("before") == 0)
    return rows.withColumn("tried", here & F.col("in_time")).withColumn("cut", here & ~F.col("in_time")).withColumn("total", F.col("sum") + F.col("logprob"))


def _after(tried: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs with what a round has added: counters, and an end by a proof, a crash or the clock."""
    t = F.col("tried")
    g = tried.groupBy("problem").agg(F.count_if(t).alias("t"), F.count_if(t & (F.col("outcome") != "rejected")).alias("c"), F.coalesce(F.sum(F.when(t, F.col("elapsed_s"))), F.lit(0.0)).alias("s"),
                                     F.max(F.when(t & (F.col("outcome") == "proved"), F.concat("path", F.array("tactic")))).alias("found"), F.max(t & (F.col("outcome") == "crash")).alias("crashed"), F.max("cut").alias("cut"))
    j = runs.join(g, "problem")
    status = F.when(F.col("found").isNotNull(), "proved").when(F.coalesce("crashed", F.lit(False)), "error").when(F.col("cut"), "exhausted")
    return j.select("problem", status.alias("status"), F.col("found").alias("proof"), (F.col("n_expansions") + 1).alias("n_expansions"), (F.col("n_tactics") + F.col("t")).cast("int").alias("n_tactics"), (F.col("n_calls") + F.col("c")).cast("int").alias("n_calls"),
                    (F.col("elapsed_s") + F.col("s")).alias("elapsed_s"), F.when(F.col("found").isNull() & ~F.coalesce("crashed", F.lit(False)) & F.col("cut"), "wall_clock_s").alias("limit_hit"))


def _frame(done: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(done, columns=[c.strip().split()[0] for c in SCHEMA.split(", ")])
