"""Ordered funnels against brute force, with clients that lie across many ranges."""
import bisect
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from tessella.llm import funnel

BEGIN = datetime(2024, 1, 1)
SCHEMA = "client_id long, kind string, ts timestamp_ntz, funnel string, n1 long, slot int"


def brute(rows, funnels, minutes):
    limit, of = minutes * 60_000_000, defaultdict(lambda: defaultdict(list))
    for client, kind, ts in {r[:3] for r in rows if None not in r[:3]}:
        of[client][kind].append((ts - BEGIN) // timedelta(microseconds=1))
    out = {}
    for name, kinds, excluded in funnels:
        for client, times in of.items():
            for t in times.values():
                t.sort()
            n, late = Counter(), defaultdict(list)
            for t in times.get(kinds[0], []):
                n[1] += 1
                for k in range(1, len(kinds)):
                    own = times.get(kinds[k], [])
                    i = bisect.bisect_right(own, t)
                    bad = times.get(excluded, [])
                    j = bisect.bisect_right(bad, t)
                    if i == len(own) or own[i] - t > limit or (j < len(bad) and bad[j] <= own[i]):
                        break
                    n[k + 1] += 1
                    late[k + 1].append(own[i] - t)
                    t = own[i]
            if n[1]:
                q = {k: sorted(v)[-(-90 * len(v) // 100) - 1] for k, v in late.items()}
                out[name, client] = [*(n[k] for k in (1, 2, 3, 4)), max(k for k in n if n[k]), *(q.get(k) for k in (2, 3, 4))]
    depth = Counter((name, v[4]) for (name, _), v in out.items())
    return {k: (*v, depth[k[0], v[4]]) for k, v in out.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 1) for r in rows], SCHEMA).repartition(5)


def measured(df):
    return {(r.funnel, r.client_id): tuple(r)[2:] for r in df.collect()}


@pytest.mark.parametrize(("parts", "gap", "minutes"), [(40, 2_000, 60), (40, 20, 60), (7, 400, 5)])
def test_funnels(spark, parts, gap, minutes):
    rng = random.Random(parts + gap)
    kinds, weights = ["view", "click", "purchase", "signup", "error", "other", None], [40, 30, 15, 5, 3, 2, 1]
    rows, t = [], 0
    for _ in range(3000):
        t += rng.choice([0, 1, rng.randint(0, gap), rng.randint(0, gap)]) * 1_000_000
        client = rng.choices([7, 1, 2, None, rng.randint(3, 40)], [50, 10, 5, 1, 30])[0]
        rows.append((client, rng.choices(kinds, weights)[0], BEGIN + timedelta(microseconds=t) if rng.random() > 0.01 else None))
    rows += rng.choices(rows, k=200)
    rng.shuffle(rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = measured(funnel.funnel_report(table(spark, rows), limit=minutes * 60_000_000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute(rows, funnel.FUNNELS, minutes)
    assert got == want and any(v[3] for v in want.values())


def test_ties_and_bounds(spark):
    at = lambda s: BEGIN + timedelta(seconds=s)
    rows = [
        (1, "view", at(0)), (1, "click", at(0)), (1, "click", at(3600)),  # a click at the view's own time isn't later; one 60 minutes on is
        (2, "view", at(0)), (2, "click", at(3601)),
        (3, "view", at(0)), (3, "error", at(0)), (3, "click", at(9)),  # an error at the step before's time doesn't count
        (4, "view", at(0)), (4, "error", at(9)), (4, "click", at(9)),  # one at the next step's does
        (5, "view", None), (None, "view", at(0)), (6, None, at(0)), (7, "error", at(0)),
    ]
    got = measured(funnel.funnel_report(table(spark, [*rows, *rows])))
    assert got == brute(rows, funnel.FUNNELS, 60)
    assert [got["A", c][1] for c in (1, 2, 3, 4)] == [1, 0, 1, 0] and ("A", 5) not in got


def test_without_rows_and_wrong_funnels(spark):
    assert funnel.funnel_report(table(spark, [(1, "view", BEGIN)]).where("false")).count() == 0
    with pytest.raises(ValueError, match="same number"):
        funnel.funnel_report(table(spark, [(1, "view", BEGIN)]), [("a", ["x", "y"], "z"), ("b", ["x"], "z")])


def test_waiting_attempts_leave(monkeypatch):
    sweep = funnel._Sweep([([0, 1], 2)], 3, 10)
    most = 0
    for t in range(10_000):
        sweep.row(1, t, 1)
        most = max(most, len(sweep.waiting[0][1]))
    assert most == 11


def test_weighted_quantile(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([rng.randint(0, 2**32), rng.randint(0, 50)]), rng.randint(1, 9)) for _ in range(700)]
    got = {r.g: r.d for r in funnel.weighted_quantile(spark.createDataFrame(rows, "g string, d long, n long"), ["g"], "d", "n", 90, 100).collect()}
    for g in "ab":
        flat = sorted(d for x, d, n in rows if x == g for _ in range(n))
        assert got[g] == flat[-(-90 * len(flat) // 100) - 1]
