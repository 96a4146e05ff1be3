"""Searches in tasks and in rounds give the same."""
import random

import pytest

from tessella.operators import search

SCHEMA = "problem long, state long, tactic string, logprob double, outcome string, next long, elapsed_s double"


def graph(rng, problem, states, fan):
    rows = []
    for s in range(states):
        for i in range(rng.randint(0, fan)):
            outcome = rng.choices(["progress", "error", "rejected", "proved", "crash"], [70, 15, 8, 5, 1])[0]
            rows.append((problem, s, f"t{i}", -rng.randint(1, 400) / 128, outcome, rng.randint(0, states), rng.randint(0, 8) / 4))
    return rows


@pytest.mark.parametrize("limits", [search.Limits(6, 3, 3, None, 0.5), search.Limits(7, 4, 9, 6.0, 1.0)])
def test_rounds_equal_tasks(spark, limits):
    rng = random.Random(9)
    rows = [r for p in range(60) for r in graph(rng, p, 12, 4)]
    rows += [(100, 0, "x", -1.0, "closed", 0, 0.0), (101, 3, "x", -1.0, "proved", 4, 1.0), (102, 0, "x", -1.0, "progress", 1, 100.0), (102, 1, "x", -1.0, "proved", 2, 1.0), (103, 0, "a", -1.0, "progress", 0, 0.0)]
    t = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(map(tuple, df.collect()))
    tasks, rounds = key(search.in_tasks(t, limits)), key(search.in_rounds(t, limits))
    assert [(*r[:2], r[2] and list(r[2]), *r[3:]) for r in rounds] == [(*r[:2], r[2] and list(r[2]), *r[3:]) for r in tasks]
    kinds = {r[1] for r in tasks}
    assert kinds == {"proved", "error", "exhausted", "no_candidates"} and {r[7] for r in tasks} >= ({"max_expansions", None} if limits.wall_clock_s is None else {"wall_clock_s", None})
    by = {r[0]: r for r in tasks}
    assert by[100][1:6] == ("error", None, 0, 0, 0) and by[101][1] == by[103][1] == "no_candidates"


def test_large_problems_are_told_apart(spark):
    rng = random.Random(2)
    t = spark.createDataFrame([r for p in range(3) for r in graph(rng, p, 4 + 6 * p, 3)], SCHEMA)
    want = sorted(map(repr, search.best_first(t, max_expansions=4).collect()))
    assert sorted(map(repr, search.best_first(t, max_expansions=4, task_rows=12).collect())) == want and search.LARGE.max_expansions == 1024


def test_counters(spark):
    rows = [(1, 0, "a", -0.1, "rejected", 0, 0.5), (1, 0, "b", -0.2, "progress", 1, 0.5), (1, 1, "c", -0.1, "proved", 2, 0.5)]
    r = search.best_first(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.status, list(r.proof), r.n_expansions, r.n_tactics, r.n_calls, r.elapsed_s) == ("proved", ["b", "c"], 2, 3, 2, 1.5)
    r = search.best_first(spark.createDataFrame(rows, SCHEMA).drop("elapsed_s"), wall_clock_s=0.0).first()
    assert r.status == "proved" and r.elapsed_s == 0.0
    r = search.best_first(spark.createDataFrame(rows, SCHEMA), wall_clock_s=0.9).first()
    assert (r.status, r.limit_hit, r.n_tactics) == ("exhausted", "wall_clock_s", 2)
